"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """The running session or a new one, with UTC and adaptive execution; ``conf`` keys use "_" for "."."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    spark = builder.config(map=DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
