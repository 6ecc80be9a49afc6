"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Where none is set, one of this machine is, but only for a local master."""
    context = spark.sparkContext
    found = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandset-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")
