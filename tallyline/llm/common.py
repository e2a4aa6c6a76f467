"""What the training-data operators share: tables, written intermediate tables, and per-worker caches.

Functions that run on executors are pickled by value, so a cluster needs only the third-party libraries, not
this package, on its workers.
"""

from __future__ import annotations

import gc
import pickle
import sys
import uuid
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JError
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch

cloudpickle.register_pickle_by_value(sys.modules["tallyline"])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``, by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A setting of Spark that frees the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written Parquet table in the shared folder: cuts the lineage and survives lost executors.

    What the query shuffled is freed at its end: the table is read from now on.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame | None) -> None:
    """Deletes the written table that ``df`` reads, or is a projection of; only for tables that nothing reads again."""
    if df is not None:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/tallyline/" in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Has the driver collect its garbage and give what it has freed back to the system: plans of many steps fill its heap,
    which else grows to its limit, and what was broadcast for them leaves the executors only with it. Python goes first,
    since its frames hold plans."""
    gc.collect()
    spark._jvm.System.gc()
    _trim(spark)


def _trim(spark: SparkSession) -> None:
    """Has the driver's JVM give back freed memory outside its heap: hundreds of threads compile and plan, and the C library
    keeps what they freed, for each by itself. A JVM that has no command for it (before 17.0.9, or not on glibc) keeps it."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    objects, names, kind = jvm.java.lang.Object, jvm.java.lang.String, jvm.java.lang.Class

    def array(of: Any, *values: Any) -> Any:
        out = gateway.new_array(of, len(values))
        for i, value in enumerate(values):
            out[i] = value
        return out

    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        # by the public interface: py4j can't call methods of the server's own class
        types = [kind.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = kind.forName("javax.management.MBeanServer").getMethod("invoke", array(kind, *types))
        invoke.invoke(server, array(objects, command, "systemTrimNativeHeap", array(objects), array(names)))
    except (Py4JError, PySparkException):
        pass


#: Families that a worker keeps: those of one operator. Older ones go, so that stages don't add up in its memory.
FAMILIES = 2


def per_worker(family: str, version: str, build: Callable[[], Any]) -> Any:
    """``build()`` once for each Python worker process, whatever number of tasks it runs.

    Workers outlive jobs: only the ``FAMILIES`` used last are kept, each in the version asked for last.
    """
    kept = sys.__dict__.setdefault("_tallyline_kept", {})
    if kept.get(family, (None, None))[0] != version:
        kept.pop(family, None)
        while len(kept) >= FAMILIES:
            del kept[next(iter(kept))]
        made = build()
        kept[family] = (version, made)
    elif next(reversed(kept)) != family:
        kept[family] = kept.pop(family)
    return kept[family][1]


def sent(spark: SparkSession, kind: str, value: Any) -> Callable[[], Any]:
    """``value`` as a broadcast for functions on executors, which needs none of this package there.

    What is called there gives it, unpacked once for each worker, which holds one value of a kind.
    """
    kept, version = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex
    return lambda: per_worker(f"sent {kind}", version, lambda: pickle.loads(kept.value))


def crc32_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``: the fold of a row. A null value counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n
