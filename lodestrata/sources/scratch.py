"""The folder for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new path in the folder all executors share, ``spark.checkpoint.dir``.  Where none is set,
    only a local master, which is one machine, makes one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-scratch-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root}/{uuid.uuid4().hex}"
