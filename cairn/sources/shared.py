"""A folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder named by ``spark.checkpoint.dir``.

    A session that runs inside one machine may do without that setting and gets
    a temporary folder. On a cluster there is no folder to fall back on, as the
    driver's own disk is not the executors'.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cairn-shared-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
