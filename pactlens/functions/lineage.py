"""Where intermediate results go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text, and rows, per task.
TASK_BYTES, TASK_ROWS = 32_000_000, 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder a cluster names in spark.checkpoint.dir; a local session without one gets one of this machine."""
    context = spark.sparkContext
    named, current = spark.conf.get("spark.checkpoint.dir", None), context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pactlens-"))
        current = context._jsc.sc().getCheckpointDir()
    return named or current.get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """`df` materialised in the shared folder, its lineage cut; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def tasks_of(df: DataFrame, *texts: str | Column, limit: int | None = None) -> int:
    """So many tasks that none holds more than about `limit` bytes of these columns, or TASK_ROWS rows; text compresses too well to go by its shuffled size."""
    size, rows = df.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c in texts), F.lit(0))), F.count("*")).first()
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // (limit or TASK_BYTES)), -(-rows // TASK_ROWS))
