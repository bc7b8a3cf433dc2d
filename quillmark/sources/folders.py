"""The folder for tables that jobs write and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the session's checkpoint folder, which driver and executors share.

    Where `spark.checkpoint.dir` is unset, a temporary folder serves a local master alone.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillmark-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"
