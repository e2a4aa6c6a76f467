"""The dynamic text/number rules of record programs as Column functions.

A text is a number if, trimmed, all of it reads as one; else its value is the longest leading [sign]digits[.digits],
else 0. Two values compare as numbers if both are, else as text. All functions are total: nothing raises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_MANTISSA = r"(?:[0-9]+\.?[0-9]*|\.[0-9]+)"
_NUMERIC = rf"(?iU)^\s*[+-]?(?:{_MANTISSA}(?:e[+-]?[0-9]+)?|inf|infinity|nan)\s*\z"
#: All of a number, or its leading digits: an exponent or a name counts only if nothing follows.
_LEADING = rf"(?iU)^\s*([+-]?(?:{_MANTISSA}(?:e[+-]?[0-9]+(?=\s*\z))?|(?:infinity|inf|nan)(?=\s*\z)))"
_SPACE = r"(?U)^\s+|\s+$"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``; a long expression is evaluated once instead of wherever the body uses it."""
    if len(str(value)) < 120:
        return body(value)
    return F.transform(F.array(value), body)[0]


def trim(s: Column) -> Column:
    """Without white space (of any kind) at both ends."""
    return F.regexp_replace(s, _SPACE, "")


def looks_numeric(s: Column) -> Column:
    return s.rlike(_NUMERIC)


def to_number(s: Column) -> Column:
    """The number that a text stands for; null counts as empty. One pass of one pattern."""
    return F.coalesce(F.regexp_extract(s, _LEADING, 1).try_cast("double"), F.lit(0.0))


def number_text(n: Column) -> Column:
    """A number as printed: integers plain, others with at most six decimals."""
    return once(n.cast("double"), _number_text)


def _number_text(n: Column) -> Column:
    # doubles of this size are written without an exponent, and most have few decimals; few branches keep the code small
    # enough to be compiled
    exact = n.cast("string")
    few = (F.abs(n) >= 1e-3) & (F.abs(n) < 9e6) & (F.length(exact) - F.instr(exact, ".") <= 6)
    other = F.when(F.abs(n) < float("inf"), F.regexp_replace(F.format_string("%.6f", n), r"\.?0+$", "")).when(F.isnan(n), "nan").when(n > 0, "inf").otherwise("-inf")
    return F.when((n == F.floor(n)) & (F.abs(n) < 9.2e18), n.try_cast("bigint").cast("string")).when(few, exact).otherwise(other)


def truthy(value: Column, numeric: bool = False) -> Column:
    """Numbers: not 0; texts: neither empty nor "0"."""
    return F.coalesce(value != 0 if numeric else (value != "") & (value != "0"), F.lit(False))


def compare(op: str, a: Column, b: Column) -> Column:
    """``a op b`` for texts: as numbers if both look like numbers, else byte-wise."""
    ops = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "==": lambda x, y: x == y, "!=": lambda x, y: x != y}
    test = lambda x, y: F.when(looks_numeric(x) & looks_numeric(y), ops[op](to_number(x), to_number(y))).otherwise(ops[op](x, y))
    return once(a, lambda x: once(b, lambda y: test(x, y)))


def divide(a: Column, b: Column) -> Column:
    """a / b, 0 if b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the sign of a, 0 if b is 0."""
    return F.coalesce(F.try_mod(a, b), F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))


def or_default(a: Column, b: Column) -> Column:
    """a unless it is null or empty, else b."""
    return F.coalesce(F.nullif(a, F.lit("")), b)
