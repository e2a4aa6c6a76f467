"""Warm medians of the headline queries, one JSON line.

Tables: $BENCH_SF_DIR (default /root/testdata/sf0.1); cores: $BENCH_CPUS. b1 to b16 are the sixteen micro workloads of
the published baseline on lineitem; t1 to t8 run the same as programs over a text file of its lines; p and w are programs and
ordered operators over tables. Each query runs once to warm up, then RUNS times; results go to a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions import arrays, coerce, strings
from tallyline.lang import Program
from tallyline.operators import aggregate, joins
from tallyline.operators.ordered import Ordered
from tallyline.session import session
from tallyline.sources import readers, writers
from tallyline.sources.scratch import scratch

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def queries(spark) -> dict:  # noqa: ANN001
    t = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    line = lambda: t("lineitem")
    path = scratch(spark, "bench-lines")
    writers.write_lines(line().select(F.concat_ws(" ", "l_orderkey", F.concat(F.lit("user_"), F.col("l_suppkey")), "l_quantity", F.when(F.col("l_returnflag") == "N", "active").otherwise("inactive")).alias("line")), path)
    words = scratch(spark, "bench-words")
    writers.write_lines(line().select(F.concat_ws("_", "l_returnflag", "l_linenumber").alias("line")), words)
    text = lambda source, *paths: Program(source).run(spark, list(paths) or [path]).lines
    table = lambda source, name, order: Program(source).on(spark, t(name), order).lines
    lookup = lambda: joins.lookup(line().select("l_orderkey", "l_partkey"), "l_orderkey", joins.array_of(line(), "l_orderkey", "l_suppkey", "l_linenumber"), "s")
    quantity = F.col("l_quantity")
    return {
        "b1_print_field": lambda: line().select("l_partkey"),
        "b2_sum": lambda: line().agg(F.sum("l_quantity").alias("s")),
        "b3_regex_count": lambda: line().filter(F.col("l_returnflag").rlike("[AR]")).agg(F.count("*").alias("n")),
        "b4_assign_print": lambda: writers.printed(line().withColumn("l_tax", F.col("l_orderkey") + quantity), *line().columns),
        "b5_group_count": lambda: aggregate.frequency(line(), "l_suppkey"),
        "b6_frequency": lambda: aggregate.frequency(readers.lines(spark, words), "value"),
        "b7_gsub": lambda: readers.lines(spark, path).select(strings.gsub(F.col("value"), "active", "on").alias("value")),
        "b8_join": lookup,
        "b9_count_lines": lambda: readers.lines(spark, path).agg(F.count("*").alias("n")),
        "b10_grep": lambda: readers.lines(spark, path).filter(F.col("value").rlike("inactive")),
        "b11_cut": lambda: readers.lines(spark, path).select(F.get(F.split("value", " ", 3), F.lit(1)).alias("f")),
        "b12_head": lambda: readers.lines(spark, path).limit(100),
        "b13_distinct": lambda: readers.lines(spark, words).distinct(),
        "b14_mean": lambda: line().agg(F.avg("l_extendedprice").alias("m")),
        "b15_median": lambda: aggregate.exact_quantiles(line(), "l_extendedprice", {"m": 50}),
        "b16_reverse": lambda: readers.lines(spark, words).select(F.reverse("value").alias("v")),
        "t1_print_field": lambda: text("{ print $2 }"),
        "t2_sum": lambda: text("{ s += $3 } END { print s }"),
        "t3_regex_count": lambda: text("/inactive/ { n++ } END { print n }"),
        "t4_assign_print": lambda: text("{ $5 = $1 + $3; print }"),
        "t5_group_count": lambda: text("{ n[$2]++ } END { for (k in n) print k, n[k] }"),
        "t6_distinct": lambda: text("!seen[$0]++", words),
        "t7_gsub": lambda: text('{ gsub(/active/, "on"); print }'),
        "t8_join": lambda: text("NR == FNR { a[$1] = $3; next } ($1 in a) { print $1, a[$1] }", path, path),
        "p1_group_sum": lambda: table("{ s[$l_returnflag] += $l_quantity; n[$l_returnflag]++ } END { for (k in s) @sort print k, s[k], n[k] }", "lineitem", "l_orderkey"),
        "p2_filter": lambda: table("$l_quantity > 45 { print $l_orderkey, $l_partkey }", "lineitem", "l_orderkey"),
        "p3_statistics": lambda: table("{ a[NR] = $value } END { print mean(a), median(a), p(a, 95) }", "events", "event_id"),
        "w1_running_total": lambda: Ordered(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey").running_sum(F.col("o_totalprice"), "s"),
        "w2_range": lambda: Ordered(t("events"), "event_id").between(F.col("event_type") == "signup", F.col("event_type") == "purchase"),
        "w3_top": lambda: line().groupBy("l_suppkey").agg(F.collect_list("l_quantity").alias("a")).select("l_suppkey", arrays.top(F.col("a"), 3).alias("top")),
        "w4_coercion": lambda: readers.lines(spark, path).agg(F.sum(coerce.to_number(F.get(F.split("value", " "), F.lit(2)))).alias("s")),
    }


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session(f"local[{CPUS}]", spark_sql_shuffle_partitions=CPUS, spark_ui_enabled="false", spark_driver_memory="8g")
    spark.conf.set("spark.sql.shuffle.partitions", CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    chosen, times = sys.argv[1:], {}
    for name, query in queries(spark).items():
        if chosen and not any(name.startswith(c) for c in chosen):
            continue
        drain(query())
        seconds = []
        for _ in range(RUNS):
            began = time.perf_counter()
            drain(query())
            seconds.append(time.perf_counter() - began)
        times[name] = round(statistics.median(seconds), 4)
    print(json.dumps({"metric": "sum of warm medians", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(FOLDER.rstrip("/"))}))


if __name__ == "__main__":
    main()
