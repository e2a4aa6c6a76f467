"""State that lasts over batches: files that arrive one after the other."""

import time

from pyspark.sql import functions as F

from tallyline.streaming import stream


def arrive(spark, path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        if k + 1 < len(batches):
            time.sleep(1.1)  # files are taken by modification time


def test_count_window_keeps_state(spark, tmp_path):
    path = str(tmp_path / "in")
    batches = [[("a", 1, 1.0), ("b", 2, 10.0)], [("a", 3, 2.0), ("a", 4, 3.0)], [("b", 5, 20.0), ("a", 6, 4.0)]]
    arrive(spark, path, batches, "k string, o long, v double")
    out = stream.count_window(stream.tables(spark, path, "k string, o long, v double"), "k", "o", "v", 3)
    got = {r["o"]: r["mean"] for r in stream.drained_to(out, str(tmp_path / "out"), str(tmp_path / "c")).collect()}
    assert got == {1: 1.0, 2: 10.0, 3: 1.5, 4: 2.0, 5: 15.0, 6: 3.0}


def test_late_rows_are_dropped(spark, tmp_path):
    path = str(tmp_path / "in")
    at = lambda s: F.timestamp_seconds(F.lit(s))
    for s in (100, 4000, 4010, 50, 9000, 9010):
        spark.range(1).select(at(s).alias("ts"), F.lit(1.0).alias("v")).write.mode("append").parquet(path)
        time.sleep(1.1)
    out = stream.tumbling(stream.tables(spark, path, "ts timestamp, v double"), "ts", "10 minutes", "5 minutes", value="v")
    got = stream.drained_to(out, str(tmp_path / "out"), str(tmp_path / "c")).select(F.unix_timestamp("window.start").alias("s"), "n").collect()
    assert {r["s"]: r["n"] for r in got} == {0: 1, 3600: 2}


def test_running_groups_to_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\ny\nx\n")
    out = stream.lines(spark, str(tmp_path / "in")).filter("value = 'x'")
    assert stream.drained_to(out, str(tmp_path / "out"), str(tmp_path / "c")).count() == 2


def test_reports_of_each_batch(spark, tmp_path):
    """The last report of each key counts, whichever batch made it."""
    path = str(tmp_path / "in")
    arrive(spark, path, [[("a", 1.0), ("b", 5.0)], [("a", 2.0)], [("c", 7.0)]], "k string, v double")
    out = stream.running_groups(stream.tables(spark, path, "k string, v double"), "k", "v")
    for mode in ("update", "complete"):
        got = stream.reported(out, ["k"], str(tmp_path / mode), str(tmp_path / f"c{mode}"), mode).collect()
        assert sorted((r["k"], r["n"], r["sum"], r["min"], r["max"]) for r in got) == [("a", 2, 3.0, 1.0, 2.0), ("b", 1, 5.0, 5.0, 5.0), ("c", 1, 7.0, 7.0, 7.0)]
