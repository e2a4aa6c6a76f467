"""What workers keep, what is freed, and how values reach executors."""

import os
import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyline.llm import common


def test_a_worker_keeps_the_families_used_last():
    sys.__dict__.pop("_tallyline_kept", None)
    built = []

    def make(name):
        return lambda: built.append(name) or name

    for family, version in (("a", "1"), ("b", "1"), ("a", "1"), ("c", "1"), ("a", "1"), ("b", "1"), ("b", "2"), ("a", "1")):
        assert common.per_worker(family, version, make(family + version)) == family + version
    assert built == ["a1", "b1", "c1", "b1", "b2"]
    nested = common.per_worker("x", "1", lambda: common.per_worker("y", "1", lambda: 7))
    assert nested == 7 and len(sys.__dict__["_tallyline_kept"]) <= common.FAMILIES + 1
    del sys.__dict__["_tallyline_kept"]


def test_written_tables_are_deleted_when_told(spark):
    one = common.written(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count(), "kept")
    assert one.count() == 3
    files = [f.removeprefix("file://") for f in one.inputFiles()]
    assert files and all(map(os.path.exists, files))
    common.discard(one.select("k"))
    assert not any(map(os.path.exists, files))
    common.discard(None)
    common.discard(spark.range(3))


def test_values_reach_executors(spark):
    known = common.sent(spark, "test", {"x": 5})

    def run(batches):
        for batch in batches:
            value = known()["x"]
            yield batch.set_column(0, "id", [value + v.as_py() for v in batch.column(0)])

    assert sorted(r["id"] for r in spark.range(3).mapInArrow(run, "id long").collect()) == [5, 6, 7]


def test_tidy_gives_back_memory_outside_the_heap(spark):
    """Freed blocks below one that is still held: the C library gives these back only if told to."""
    platform = spark._jvm.org.apache.spark.unsafe.Platform
    rollup = Path(f"/proc/{spark._jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")
    if not rollup.exists():
        pytest.skip("memory can't be read here")
    held = lambda: int(re.search(r"Anonymous:\s+(\d+)", rollup.read_text())[1]) / 1024
    for _ in range(2):
        spark._jvm.System.gc()
    size = 100_000
    blocks = [platform.allocateMemory(size) for _ in range(1500)]
    for b in blocks:
        platform.copyMemory(None, b, None, b + size // 2, size // 2)
    full = held()
    for b in blocks[:-1]:
        platform.freeMemory(b)
    spark._jvm.System.gc()
    freed = held()
    common.tidy(spark)
    after = held()
    platform.freeMemory(blocks[-1])
    assert after < freed - 40, (full, freed, after)
