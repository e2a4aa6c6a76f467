"""Arithmetic, bit and random functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def integer(x: Column) -> Column:
    """Towards zero; from 2**53 on doubles are whole already."""
    return F.when(F.abs(x) < float(1 << 53), F.signum(x) * F.floor(F.abs(x))).otherwise(x)


def rounded(x: Column) -> Column:
    """Half away from zero."""
    return F.when(F.abs(x) < float(1 << 52), F.signum(x) * F.floor(F.abs(x) + 0.5)).otherwise(x)


def logarithm(x: Column) -> Column:
    """-inf at 0, nan below."""
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


def bit_and(a: Column, b: Column) -> Column:
    return a.cast("bigint").bitwiseAND(b.cast("bigint"))


def bit_or(a: Column, b: Column) -> Column:
    return a.cast("bigint").bitwiseOR(b.cast("bigint"))


def bit_xor(a: Column, b: Column) -> Column:
    return a.cast("bigint").bitwiseXOR(b.cast("bigint"))


def shift_left(a: Column, n: int) -> Column:
    return F.shiftleft(a.cast("bigint"), n & 63)


def shift_right(a: Column, n: int) -> Column:
    """Logical."""
    return F.shiftrightunsigned(a.cast("bigint"), n & 63)


def complement(a: Column) -> Column:
    return F.bitwise_not(a.cast("bigint"))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone, whatever the partitioning."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
