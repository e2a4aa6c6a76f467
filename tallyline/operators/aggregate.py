"""Group accumulators, payload maxima, ordered concatenation, exact statistics and histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequency(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def shares(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts and their percentage of all rows."""
    return frequency(rows, *keys).withColumn("pct", F.col("n") / rows.select(F.count("*")).scalar() * 100)


def concatenated(rows: DataFrame, keys: list[str], value: Column, order: str, sep: str = ",") -> DataFrame:
    """Each group's values joined in record order. A group's list is one value: for groups that fit in memory."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["v"]), sep).alias("joined"))


def best(rows: DataFrame, by: Column, payload: Column, order: str, largest: bool = True) -> Column:
    """The payload of the first record with the largest (smallest) ``by``: an aggregate."""
    return F.max_by(payload, F.struct(by, -F.col(order))) if largest else F.min_by(payload, F.struct(by, F.col(order)))


def last_written(value: Column, order: str) -> Column:
    return F.max_by(value, F.col(order))


def first_written(value: Column, order: str) -> Column:
    return F.min_by(value, F.col(order))


def percentile(value: Column, p: float) -> Column:
    """Exact, interpolated at rank p/100 * (n - 1); p is clamped to 0..100."""
    return F.percentile(value.cast("double"), F.lit(min(max(p, 0.0), 100.0) / 100))


def exact_quantiles(rows: DataFrame, value: str, percents: dict[str, float], *keys: str, accuracy: int = 20_000) -> DataFrame:
    """The same quantiles as ``percentile`` for each group, without holding all its distinct values in one place.

    A first pass brackets each quantile by approximate ones, whose rank error is at most n / accuracy; a second pass
    counts the rows below each bracket and gathers only those within it: 6 n / accuracy values, or the 4 * accuracy at
    most of a small group. Beyond 1e9 rows a group a larger accuracy keeps that small. Only groups of more rows have
    brackets, so these are one for 4 * accuracy rows of all at most, and are broadcast: no task sorts a group's rows.
    """
    v = F.col(value).cast("double")
    kept = rows.filter(v.isNotNull()).select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], v.alias("_v"))
    groups = [f"_g{i}" for i in range(len(keys))]
    names = list(percents)
    shares = [min(max(p, 0.0), 100.0) / 100 for p in percents.values()]
    slack = 2.0 / accuracy
    probes = [x for s in shares for x in (max(0.0, s - slack), min(1.0, s + slack))]
    first = kept.groupBy(*groups).agg(F.count("*").alias("_n"), F.percentile_approx("_v", probes, accuracy).alias("_b"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    parts = []
    for i, s in enumerate(shares):
        # ranks are off by less than the slack less two
        low = F.col("_min") if s <= slack else F.element_at("_b", 2 * i + 1)
        high = F.col("_max") if s >= 1 - slack else F.element_at("_b", 2 * i + 2)
        parts.append(F.struct(F.lit(i).alias("i"), low.alias("low"), high.alias("high")))
    large = first.filter(F.col("_n") > 4 * accuracy)
    bounds = large.select(*[F.col(g).alias(f"{g}b") for g in groups], F.array(*parts).alias("_parts"))
    if groups:
        on = [F.col(g).eqNullSafe(F.col(f"{g}b")) for g in groups]
        joined = kept.join(F.broadcast(bounds), on, "left")
    else:
        joined = kept.withColumn("_parts", bounds.select("_parts").scalar())
    # a small group has no brackets and is gathered whole
    sides = [F.struct(F.when(F.col("_v") < F.col("_parts")[i]["low"], 1).otherwise(0).alias("below"), F.when(F.col("_parts").isNull() | F.col("_v").between(F.col("_parts")[i]["low"], F.col("_parts")[i]["high"]), F.col("_v")).alias("v")) for i in range(len(shares))]
    gathered = joined.groupBy(*groups).agg(F.count("*").alias("_n"), *[a for i, x in enumerate(sides) for a in (F.sum(x["below"]).alias(f"_s{i}"), F.array_sort(F.collect_list(x["v"])).alias(f"_w{i}"))])
    out = [F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)]
    for i, name in enumerate(names):
        at = F.lit(shares[i]) * (F.col("_n") - 1)
        lower_rank = F.floor(at)
        a = F.get(f"_w{i}", (lower_rank - F.col(f"_s{i}")).cast("int"))
        b = F.get(f"_w{i}", (F.ceil(at) - F.col(f"_s{i}")).cast("int"))
        out.append((a + (b - a) * (at - lower_rank)).alias(name))
    return gathered.select(*out)


def summary(value: Column) -> list[Column]:
    """sum, mean, variance and stddev (population), min, max; the median is one of ``exact_quantiles``."""
    v = value.cast("double")
    return [F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(v), F.lit(0.0)).alias("variance"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("stddev"), F.min(v).alias("min"), F.max(v).alias("max")]


def interquartile_mean(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """The mean of the values whose rank is from max(ceil(n/4), 1) to floor(3n/4); of all values if there are none.

    From counts of distinct values, so that a hot group is pre-aggregated before it is ranked.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    ranked = counted.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys).orderBy("v"))).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    first, final = F.greatest(F.ceil(F.col("n") * 0.25), F.lit(1)), F.floor(F.col("n") * 0.75)
    taken = F.greatest(F.least(F.col("upto"), final) - F.greatest(F.col("upto") - F.col("c") + 1, first) + 1, F.lit(0))
    some = ranked.withColumn("t", taken).groupBy(*keys).agg(F.sum(F.col("v") * F.col("t")).alias("s"), F.sum("t").alias("t"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("m"))
    return some.select(*keys, F.when(F.col("t") > 0, F.col("s") / F.nullif(F.col("t"), F.lit(0))).otherwise(F.col("m")).alias("iqm"))


def nice_bins(low: float, high: float, n: int) -> tuple[float, float, int]:
    """(start, width, bins): widths of 1, 2 or 5 times a power of ten, aligned, about log2 n + 1 bins, 3 at least."""
    wanted = max(3, math.ceil(math.log2(n) + 1) if n > 0 else 3)
    spread = high - low
    if spread <= 0:
        return low, 1.0, 1
    raw = spread / wanted
    power = 10.0 ** math.floor(math.log10(raw))
    step = next((m for m in (1.0, 2.0, 5.0) if raw / power <= m), 10.0) * power
    start, end = math.floor(low / step) * step, math.ceil(high / step) * step
    return start, step, max(1, round((end - start) / step))


def histogram(rows: DataFrame, value: str, bins: int = 0, low: float | None = None, high: float | None = None) -> DataFrame:
    """bin (from 1), low, high and n of every bin, empty ones too; values outside count in the edge bins.

    Without ``bins`` they are nice ones. Two passes: the extremes, then one aggregation by bin.
    """
    s = rows.agg(F.min(value).cast("double").alias("a"), F.max(value).cast("double").alias("b"), F.count(value).alias("n")).first()
    a, b = (s["a"] or 0.0) if low is None else low, (s["b"] or 0.0) if high is None else high
    if bins > 0:
        start, width = a, (b - a) / bins or 1.0
    else:
        start, width, bins = nice_bins(a, b, s["n"])
    spark = rows.sparkSession
    at = F.least(F.greatest(F.floor((F.col(value).cast("double") - F.lit(start)) / F.lit(width)), F.lit(0)), F.lit(bins - 1)) + 1
    counts = rows.filter(F.col(value).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    frame = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select("bin", (F.lit(start) + (F.col("bin") - 1) * width).alias("low"), (F.lit(start) + F.col("bin") * width).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def normalised(rows: DataFrame, value: str, name: str = "norm") -> DataFrame:
    """Min-max to 0..1 over all rows; 0 where all are equal. The extremes are scalar subqueries."""
    low, high = (rows.select(f(value).cast("double")).scalar() for f in (F.min, F.max))
    return rows.withColumn(name, F.when(low == high, F.lit(0.0)).otherwise((F.col(value) - low) / F.nullif(high - low, F.lit(0.0))))


def z_scores(rows: DataFrame, value: str, name: str = "z") -> DataFrame:
    mean, deviation = (rows.select(f(value)).scalar() for f in (F.avg, F.stddev_pop))
    return rows.withColumn(name, F.when(deviation == 0, F.lit(0.0)).otherwise((F.col(value) - mean) / F.nullif(deviation, F.lit(0.0))))
