"""Helpers shared by the operators: lineage cuts, code-point order, and column choice."""

from __future__ import annotations

import pickle
import tempfile

from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A session inside one machine may do without one and gets a folder of its own; on a cluster that is an error,
    as the driver's disk is not the executors'. Spark deletes checkpoints that nothing refers to any more if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` was set when the session began.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cairn-checkpoints-"))
    return context.getCheckpointDir()


def send(spark: SparkSession, value: object) -> Broadcast:
    """Broadcast a value that may hold classes of this package; :func:`sent` opens it where the package is not installed."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def sent(packed: Broadcast) -> object:
    """The value of :func:`send`, opened once a task."""
    return pickle.loads(packed.value)


def cut(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the checkpoint folder, so that a lost executor does not cost its whole history."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint()


def read(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{folder}/{table}.parquet")
    return frame.select(*columns) if columns else frame


def text_column(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def folded(frame: DataFrame, keys: tuple[str, ...], merge, shape: str, parts: int, fanout: int = 16) -> DataFrame:
    """Rows of one key merged ``fanout`` at a time, by their column ``part`` (below ``parts``), until one is left."""
    while parts > 1:
        frame = frame.withColumn("part", F.expr(f"part div {fanout}")).groupBy(*keys, "part").applyInArrow(merge, shape)
        parts = -(-parts // fanout)
    return frame
