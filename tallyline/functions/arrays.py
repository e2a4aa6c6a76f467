"""Functions of array and map values. Arrays stand for sequences 1..n, maps for associative arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import looks_numeric, to_number, truthy


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once, not for each element of the lambdas in the body."""
    return F.transform(F.array(value), body)[0]


def uniq(a: Column) -> Column:
    """Distinct values, the first of each kept."""
    return F.array_distinct(a)


def inv(m: Column) -> Column:
    """Keys and values swapped; of equal values the last key wins."""
    entries = F.map_entries(m)
    last = F.filter(entries, lambda e: ~F.exists(entries, lambda o: (o["value"] == e["value"]) & (o["key"] > e["key"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["value"], e["key"])))


def tidy(a: Column) -> Column:
    """Without empty texts and zeros."""
    return F.filter(a, lambda x: truthy(x.cast("string")))


def tidy_map(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: truthy(v.cast("string")))


def delete(m: Column, key: Column | str) -> Column:
    return F.map_filter(m, lambda k, v: k != key)


def transformed(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(a, lambda x: f(x))


def kept(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.filter(a, lambda x: f(x))


def join(a: Column, sep: str = " ") -> Column:
    return F.array_join(a, sep)


def smart_keys(m: Column) -> Column:
    """Keys: numbers in order first, then texts in order."""
    keys = F.transform(F.map_keys(m), lambda k: F.struct((~looks_numeric(k)).alias("t"), F.when(looks_numeric(k), to_number(k)).otherwise(0.0).alias("n"), k.alias("k")))
    return F.transform(F.array_sort(keys), lambda s: s["k"])


def values_by_key(m: Column) -> Column:
    return F.transform(smart_keys(m), lambda k: F.element_at(m, k))


def asort(a: Column) -> Column:
    """Numbers before texts, each in order."""
    keyed = F.transform(a, lambda x: F.struct((~looks_numeric(x)).alias("t"), F.when(looks_numeric(x), to_number(x)).otherwise(0.0).alias("n"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def asorti(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def top(a: Column, n: int) -> Column:
    return F.slice(F.sort_array(a, asc=False), 1, n)


def bottom(a: Column, n: int) -> Column:
    return F.slice(F.sort_array(a), 1, n)


def runtotal(a: Column) -> Column:
    """Cumulative sums, added in order; a null stays, and the sums begin anew after it.

    In Arrow batches: an array that a lambda carries on is copied for each element, which takes the square of its size.
    """

    @F.arrow_udf("array<double>")
    def run(lists):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        def sums(x):  # noqa: ANN001, ANN202
            if not x.null_count:
                return np.cumsum(x.to_numpy(zero_copy_only=False)) + 0.0
            out, last = [], 0.0
            for v in x.to_pylist():
                out.append(None if v is None else last + v)
                last = out[-1] or 0.0
            return out

        return pa.array([sums(x.values) if x.is_valid else None for x in lists], pa.list_(pa.float64()))

    return run(a.cast("array<double>"))


def norm(a: Column) -> Column:
    """To 0..1; 0 where all values are equal."""
    scaled = lambda e: F.transform(a, lambda x: F.when(e["high"] == e["low"], F.lit(0.0)).otherwise((x - e["low"]) / F.nullif(e["high"] - e["low"], F.lit(0.0))))
    return _bound(F.struct(F.array_min(a).alias("low"), F.array_max(a).alias("high")), scaled)


def diff(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def inter(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def union(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def seq(first: int | Column, last: int | Column) -> Column:
    """Whole numbers from first to last, up or down."""
    as_column = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.sequence(as_column(first).cast("bigint"), as_column(last).cast("bigint"))


def shuf(a: Column, seed: int) -> Column:
    return F.transform(F.array_sort(F.transform(a, lambda x, i: F.struct(F.xxhash64(x, i, F.lit(seed)).alias("h"), x.alias("x")))), lambda s: s["x"])


def samp(a: Column, n: int, seed: int) -> Column:
    """n elements without replacement."""
    return F.slice(shuf(a, seed), 1, n)


def total(a: Column) -> Column:
    return F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, total(a) / F.nullif(F.size(a), F.lit(0))).otherwise(0.0)


def variance(a: Column) -> Column:
    """Population variance."""
    squares = _bound(mean(a), lambda m: F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + (x - m) * (x - m)))
    return F.when(F.size(a) > 0, squares / F.nullif(F.size(a), F.lit(0))).otherwise(0.0)


def percentile(a: Column, p: float) -> Column:
    """Interpolated at rank p/100 * (n - 1)."""
    s = F.array_sort(a.cast("array<double>"))
    at = F.lit(min(max(p, 0.0), 100.0) / 100) * (F.size(a) - 1)
    low, high = F.get(s, F.floor(at).cast("int")), F.get(s, F.ceil(at).cast("int"))
    return F.coalesce(low + (high - low) * (at - F.floor(at)), F.lit(0.0))


def iqm(a: Column) -> Column:
    """The interquartile mean."""
    n = F.size(a)
    first = F.greatest(F.ceil(n * 0.25).cast("int"), F.lit(1))
    some = F.slice(F.array_sort(a.cast("array<double>")), first, F.greatest(F.floor(n * 0.75).cast("int") - first + 1, F.lit(0)))
    return F.when(F.size(some) > 0, mean(some)).otherwise(mean(a))
