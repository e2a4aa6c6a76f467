"""Streams: running group accumulators, event-time windows, and count windows with state that expires."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType


def tables(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    """A folder's Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def lines(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path)


def running_groups(stream: DataFrame, key: str, value: str) -> DataFrame:
    """count, sum and extremes of each key so far (complete or update mode)."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))


def tumbling(stream: DataFrame, ts: str, width: str, late: str, *keys: str, value: str) -> DataFrame:
    """count and sum in event-time windows; rows later than ``late`` are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("sum"))


def sliding(stream: DataFrame, ts: str, width: str, slide: str, late: str, *keys: str, value: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width, slide), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def sessions(stream: DataFrame, ts: str, gap: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))


def distinct(stream: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


class CountWindow(StatefulProcessor):
    """Each row with the mean of its key's last ``n`` values, its own included, in order of ``order``."""

    def __init__(self, key: str, order: str, value: str, n: int, ttl_ms: int | None = None):
        self.key, self.order, self.value, self.n, self.ttl_ms = key, order, value, n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "value double", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:  # noqa: ANN001, N802, N803
        import numpy as np
        import pandas as pd

        some = pd.concat(list(rows)).sort_values(self.order)
        last = [v for (v,) in self.held.get()] if self.held.exists() else []
        every = np.array([*last, *some[self.value]], dtype=float)
        # sums of up to n values that end at each row
        upto = np.concatenate([[0.0], np.cumsum(every)])
        end = np.arange(len(last), len(every)) + 1
        start = np.maximum(0, end - self.n)
        means = (upto[end] - upto[start]) / (end - start)
        last = every[-self.n :].tolist()
        self.held.put([(v,) for v in last])
        yield pd.DataFrame({self.key: [key[0]] * len(some), self.order: some[self.order].to_numpy(), "mean": means})

    def close(self) -> None:
        pass


def count_window(stream: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """A moving mean over the last n rows of each key; the state is n values a key, in RocksDB."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = dict(stream.dtypes)
    return stream.groupBy(key).transformWithStateInPandas(CountWindow(key, order, value, n), f"{key} {kinds[key]}, {order} {kinds[order]}, mean double", "Append", "None")


def every(stream: DataFrame, n: int, order: str) -> DataFrame:
    """Every n-th row of each batch in its order: a stateless report on what arrives."""
    return stream.withColumn("_turn", F.pmod(F.col(order), F.lit(n))).filter("_turn = 0").drop("_turn")


def reported(out: DataFrame, keys: list[str], path: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """What a stream over the files present last gives for each key: every batch reports what has changed into files.

    Nothing is gathered on the driver, and in update mode state that the watermark has passed is freed. Complete mode,
    for aggregates that can't be updated, reports everything in each batch.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch-{number:09d}")

    out.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = out.sparkSession.read.schema(StructType([*out.schema.fields, StructField("_batch", IntegerType())])).parquet(f"{path}/batch-*")
    if mode == "complete":
        return rows.filter(F.col("_batch") == rows.select(F.max("_batch")).scalar()).drop("_batch")
    rest = [c for c in out.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last")).select(*keys, "_last.*")


def drained_to(out: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that a stream over the files present gives, as Parquet files (append mode)."""
    out.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return out.sparkSession.read.parquet(path)
