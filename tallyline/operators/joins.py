"""Two-table lookups: the first table is an array that keeps the last value of each key, the second one probes it.

The build side has one row a key. Spark broadcasts it where its size, as measured at run time, is below the session's
threshold, and shuffles both sides beyond; no hint overrides that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_of(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key and value, the last write of each key."""
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(value, order).alias("_value"))


def _on(key: str) -> Column:
    return F.col(key) == F.col("_key")


def lookup(probe: DataFrame, key: str, array: DataFrame, name: str) -> DataFrame:
    """Probe rows whose key is in the array, with its value."""
    return probe.join(array, _on(key)).withColumnRenamed("_value", name).drop("_key")


def lookup_or(probe: DataFrame, key: str, array: DataFrame, name: str, default: Column) -> DataFrame:
    return probe.join(array.withColumn("_there", F.lit(True)), _on(key), "left").withColumn(name, F.when(F.col("_there"), F.col("_value")).otherwise(default)).drop("_key", "_value", "_there")


def semi(probe: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    return probe.join(keys, _on(key), "left_semi")


def anti(probe: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    return probe.join(keys, _on(key), "left_anti")


def full(left: DataFrame, right: DataFrame) -> DataFrame:
    """key, left and right value for all keys of two arrays."""
    other = right.select(F.col("_key").alias("_key2"), F.col("_value").alias("_value2"))
    return left.join(other, F.col("_key").eqNullSafe(F.col("_key2")), "full_outer").select(F.coalesce("_key", "_key2").alias("key"), F.col("_value").alias("left_value"), F.col("_value2").alias("right_value"))


def updated(probe: DataFrame, key: str, column: str, array: DataFrame) -> DataFrame:
    """The column replaced where the key is in the array."""
    return probe.join(array.withColumn("_there", F.lit(True)), _on(key), "left").withColumn(column, F.when(F.col("_there"), F.col("_value")).otherwise(F.col(column))).drop("_key", "_value", "_there")


def translated(rows: DataFrame, columns: list[str], words: dict[str, str]) -> DataFrame:
    """Each listed column's values replaced by a dictionary that the program states."""
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return reduce(lambda df, c: df.withColumn(c, F.coalesce(F.try_element_at(table, F.col(c).cast("string")), F.col(c).cast("string"))), columns, rows)


def differing(probe: DataFrame, key: str, value: str, array: DataFrame, name: str) -> DataFrame:
    """Probe rows whose key is in the array with another value."""
    return probe.join(array, _on(key)).filter(F.col(value) != F.col("_value")).withColumnRenamed("_value", name).drop("_key")
