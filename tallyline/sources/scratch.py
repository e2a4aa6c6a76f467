"""A folder for intermediate files that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Temporary folders of local sessions, by application.
_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; a temporary one only in local mode where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        application = spark.sparkContext.applicationId
        if application not in _LOCAL:
            _LOCAL[application] = tempfile.mkdtemp(prefix="tallyline-")
            atexit.register(shutil.rmtree, _LOCAL[application], True)
        found = _LOCAL[application]
    return f"{found}/tallyline/{name}-{uuid.uuid4().hex}"
