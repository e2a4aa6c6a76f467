"""Set operations on keys, and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import uniform


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose key isn't in b."""
    return a.join(b.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_semi")


def union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a, and those of b with other keys."""
    return a.unionByName(difference(b, a, key))


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return difference(a, b, key).unionByName(difference(b, a, key))


def sample(rows: DataFrame, n: int, key: Column, seed: int) -> DataFrame:
    """n rows without replacement, the same ones whatever the partitioning."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def shuffled(rows: DataFrame, key: Column, seed: int) -> DataFrame:
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key)


def bernoulli(rows: DataFrame, fraction: float, key: Column, seed: int) -> DataFrame:
    """Each row with the given chance."""
    return rows.filter(uniform(key, seed) < fraction)
