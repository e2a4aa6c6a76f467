"""Selection of records: every n-th, last n, ranges of numbers, up to an exit, the rest of a file skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import modulo


def every(rows: DataFrame, n: int, nr: str = "nr") -> DataFrame:
    """Each n-th record; with n = 0 all of them."""
    return rows.filter(modulo(F.col(nr).cast("double"), F.lit(float(n))) == 0)


def last(rows: DataFrame, n: int, nr: str = "nr") -> DataFrame:
    """The last n records."""
    return rows.orderBy(F.col(nr).desc()).limit(n)


def head(rows: DataFrame, n: int, nr: str = "nr") -> DataFrame:
    return rows.filter(F.col(nr) <= n)


def numbers(rows: DataFrame, first: int, final: int, nr: str = "nr") -> DataFrame:
    return rows.filter(F.col(nr).between(first, final))


def until(rows: DataFrame, stop: Column, nr: str = "nr") -> DataFrame:
    """Records up to the first where ``stop`` holds, that one included: an exit after its actions."""
    at = rows.filter(stop).select(F.min(nr)).scalar()
    return rows.filter(at.isNull() | (F.col(nr) <= at))


def rest_skipped(rows: DataFrame, skip: Column, file: str = "filename", fnr: str = "fnr") -> DataFrame:
    """Each file's records up to the first where ``skip`` holds, that one included."""
    at = rows.filter(skip).groupBy(F.col(file).alias("_file")).agg(F.min(fnr).alias("_stop"))
    return rows.join(at, F.col(file).eqNullSafe(F.col("_file")), "left").filter(F.col("_stop").isNull() | (F.col(fnr) <= F.col("_stop"))).drop("_file", "_stop")


def guarded(rows: DataFrame, rules: list[tuple[Column, list[Column], bool]]) -> DataFrame:
    """Pattern rules over one scan: (pattern, outputs, stops) in order; a rule that stops hides later ones.

    A row gives one output row for each rule that fires, with the rule's number.
    """
    fired, open_ = [], F.lit(True)
    for k, (pattern, outputs, stops) in enumerate(rules):
        p = F.coalesce(pattern, F.lit(False))
        fired.append(F.when(open_ & p, F.struct(F.lit(k).alias("rule"), *[o.cast("string").alias(f"c{i}") for i, o in enumerate(outputs)])))
        if stops:
            open_ = open_ & ~p
    return rows.select("*", F.explode(F.array_compact(F.array(*fired))).alias("_out")).select(*rows.columns, "_out.*")
