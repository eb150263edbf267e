"""The folder that driver and executors share, and folders of a query's own in it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, kind: str) -> str:
    """A new name below spark.checkpoint.dir; below a temporary folder only where that is unset and all is on one machine."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context._jsc.sc().isLocal():
                raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="riskloom-shared-"))
        base = context._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once: it outlives executors and isn't drawn again."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def round_trip(df: DataFrame, kind: str, write: Callable, read: Callable) -> DataFrame:
    """What read(spark, path) gives of what write(df.write, path) has written."""
    path = folder(df.sparkSession, kind)
    write(df.write, path)
    return read(df.sparkSession, path)
