"""Ordered operators against plain loops, on random rows cut into many small buckets."""

import random

import pytest
from pyspark.sql import functions as F

from tallyline.operators import aggregate, select, sets
from tallyline.operators.ordered import Ordered, placed


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(11)
    keys = sorted(rng.sample(range(2000), 300))
    rows = [(k, rng.random() < 0.2, rng.random() < 0.2, rng.choice("abc"), float(rng.randint(0, 9))) for k in keys]
    return rows, spark.createDataFrame(rows, "k int, s boolean, e boolean, c string, v double").repartition(5)


def ordered(df):
    return Ordered(df, "k", bucket_rows=20)


def ranged(rows, posix):
    out, active = [], False
    for k, s, e, *_ in rows:
        if active:
            out.append(k)
            active = not e
        elif s:
            out.append(k)
            active = not (posix and e)
    return out


@pytest.mark.parametrize("posix", [False, True])
def test_ranges(data, posix):
    rows, df = data
    got = ordered(df).between(F.col("s"), F.col("e"), posix).orderBy("k").select("k").collect()
    assert [r["k"] for r in got] == ranged(rows, posix)


def test_numbers_sums_lags(data):
    rows, df = data
    assert [r["nr"] for r in ordered(df).numbered().orderBy("k").collect()] == list(range(1, len(rows) + 1))
    total, sums = 0.0, []
    for r in rows:
        total += r[4]
        sums.append(total)
    assert [r["t"] for r in ordered(df).running_sum(F.col("v"), "t").orderBy("k").collect()] == sums
    assert [r["p"] for r in ordered(df).lag(F.col("c"), "p").orderBy("k").collect()] == [None, *[r[3] for r in rows[:-1]]]
    assert [r["p"] for r in ordered(df).lead(F.col("c"), "p").orderBy("k").collect()] == [*[r[3] for r in rows[1:]], None]


def test_moving_runs_distinct(data):
    rows, df = data
    means = [sum(r[4] for r in rows[max(0, i - 4) : i + 1]) / len(rows[max(0, i - 4) : i + 1]) for i in range(len(rows))]
    assert [r["m"] for r in ordered(df).moving(5, F.avg("v"), "m").orderBy("k").collect()] == pytest.approx(means)
    assert ordered(df).moving(5, F.avg("v"), "m", full=True).count() == len(rows) - 4
    run, runs, seen, counts = 0, [], set(), []
    for i, r in enumerate(rows):
        run += i == 0 or r[3] != rows[i - 1][3]
        runs.append(run)
        seen.add(r[4])
        counts.append(len(seen))
    assert [r["run"] for r in ordered(df).runs(F.col("c")).orderBy("k").collect()] == runs
    assert [r["n"] for r in ordered(df).running_distinct("v", "n").orderBy("k").collect()] == counts
    firsts = {}
    for r in rows:
        firsts.setdefault(r[3], r[0])
    assert {r["c"]: r["k"] for r in ordered(df).first_seen("c").collect()} == firsts


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "k int, v double")
    assert Ordered(empty, "k").numbered().count() == 0
    assert Ordered(empty, "k").running_sum(F.col("v"), "t").count() == 0
    single = spark.createDataFrame([(5, 1.0)], "k int, v double")
    assert Ordered(single, "k").numbered().first()["nr"] == 1


def test_histogram_and_means(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)], "v double")
    assert [r["n"] for r in aggregate.histogram(df, "v", 2).orderBy("bin").collect()] == [2, 3]
    assert [r["n"] for r in aggregate.histogram(df, "v", 2, 0.0, 2.0).orderBy("bin").collect()] == [0, 5]
    assert sum(r["n"] for r in aggregate.histogram(df, "v").collect()) == 5
    from tallyline.lang.builtins import interquartile_mean

    for n in (1, 2, 3, 4, 5, 7, 10, 101):
        values = [float((i * 37) % 101) for i in range(n)]
        frame = spark.createDataFrame([(v,) for v in values], "v double")
        assert aggregate.interquartile_mean(frame, "v").first()["iqm"] == pytest.approx(interquartile_mean(values))
    assert aggregate.nice_bins(0.0, 97.0, 100) == (0.0, 20.0, 5)


def test_normalised_and_selection(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 11)], "nr int, v double")
    assert aggregate.normalised(df, "v").agg(F.min("norm"), F.max("norm")).first()[:] == (0.0, 1.0)
    flat = spark.createDataFrame([(1, 2.0), (2, 2.0)], "nr int, v double")
    assert {r["norm"] for r in aggregate.normalised(flat, "v").collect()} == {0.0}
    assert {r["z"] for r in aggregate.z_scores(flat, "v").collect()} == {0.0}
    assert [r["nr"] for r in select.every(df, 4).orderBy("nr").collect()] == [4, 8]
    assert select.every(df, 0).count() == 10
    assert {r["nr"] for r in select.last(df, 2).collect()} == {9, 10}
    assert select.until(df, F.col("v") > 3).count() == 4
    assert select.until(df, F.col("v") > 99).count() == 10


def test_sets(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "x string") for s in ("abcd", "bde"))
    assert {r["x"] for r in sets.difference(a, b, "x").collect()} == set("ac")
    assert {r["x"] for r in sets.intersection(a, b, "x").collect()} == set("bd")
    assert {r["x"] for r in sets.union(a, b, "x").collect()} == set("abcde")
    assert {r["x"] for r in sets.symmetric_difference(a, b, "x").collect()} == set("ace")


@pytest.mark.parametrize("accuracy", [20, 1000, 20_000])
def test_exact_quantiles(spark, accuracy):
    rng = random.Random(9)
    rows = [(g, rng.choice([rng.gauss(0, 1), float(rng.randint(0, 3))])) for g in ("a", "b", None) for _ in range({"a": 2000, "b": 37, None: 1}[g])] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    percents = {"p0": 0, "p1": 1, "p25": 25, "p50": 50, "p95": 95, "p100": 100, "p140": 140}
    expected = {r["g"]: r for r in df.groupBy("g").agg(*[aggregate.percentile(F.col("v"), p).alias(n) for n, p in percents.items()]).collect()}
    got = aggregate.exact_quantiles(df, "v", percents, "g", accuracy=accuracy).collect()
    assert len(got) == 3
    for r in got:
        for n in percents:
            assert r[n] == pytest.approx(expected[r["g"]][n]), (r["g"], n)
    whole = aggregate.exact_quantiles(df, "v", {"m": 50}, accuracy=accuracy).first()["m"]
    assert whole == pytest.approx(df.agg(F.median("v")).first()[0])


def test_exact_quantiles_sort_no_group(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(997)).cast("double").alias("v"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = aggregate.exact_quantiles(df, "v", {"p95": 95, "p25": 25}, "g", accuracy=20)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        expected = df.groupBy("g").agg(aggregate.percentile(F.col("v"), 95).alias("p95"), aggregate.percentile(F.col("v"), 25).alias("p25"))
        assert sorted(got.collect()) == sorted(expected.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("bucket_rows", [100, 20])
def test_buckets_of_a_skewed_order(spark, bucket_rows):
    """Cut by rank: no bucket has over twice the rows of the median one, whatever the order's values."""
    rng = random.Random(12)
    keys = sorted({int(10 ** rng.uniform(0, 15)) for _ in range(4000)})
    df = spark.createDataFrame([(k, float(i % 7)) for i, k in enumerate(keys)], "k long, v double").repartition(3)
    cut = Ordered(df, "k", bucket_rows)
    sizes = sorted(r["count"] for r in cut.bucketed.groupBy("_bucket").count().collect())
    assert len(sizes) >= 30 and (bucket_rows < 100 or sizes[-1] <= 2 * sizes[len(sizes) // 2])
    assert sizes[-1] <= 2 * len(keys) / 64 + bucket_rows
    assert [r["nr"] for r in cut.numbered().orderBy("k").collect()] == list(range(1, len(keys) + 1))
    total, sums = 0.0, []
    for i in range(len(keys)):
        total += i % 7
        sums.append(total)
    assert [r["t"] for r in cut.running_sum(F.col("v"), "t").orderBy("k").collect()] == sums


def test_one_bucket_needs_no_carry(data):
    rows, df = data
    one, many = Ordered(df, "k"), ordered(df)
    for f in (lambda o: o.numbered("x"), lambda o: o.running_sum(F.col("v"), "x"), lambda o: o.lag(F.col("c"), "x"), lambda o: o.lead(F.col("c"), "x"), lambda o: o.between(F.col("s"), F.col("e")).withColumn("x", F.col("k"))):
        a, b = f(one), f(many)
        assert a.dtypes == b.dtypes
        assert a.orderBy("k").select("k", "x").collect() == b.orderBy("k").select("k", "x").collect()
        assert "Join" not in a._jdf.queryExecution().optimizedPlan().toString()


def test_placed(spark):
    rng = random.Random(13)
    names = ["".join(rng.choices("abcde", k=4)) for _ in range(500)]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "n string, i int").repartition(6)
    got = {r["i"]: r["place"] for r in placed(df, F.desc("n"), "i").collect()}
    expected = sorted(range(500), key=lambda i: ([-ord(c) for c in names[i]], i))
    assert [got[i] for i in expected] == list(range(1, 501))
    assert placed(df.limit(0), "n").count() == 0
