"""Bounds that keep plans safe on large data."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only when it is known to have at most this many rows, and as measured bytes.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# Rows that a task groups or sorts at a time, where their number is known.
TASK_ROWS = 250_000


def broadcast_if_bounded(df: DataFrame, rows: int | None) -> DataFrame:
    """Broadcast ``df`` when ``rows``, a proven upper bound of its size, is small.

    Without a bound, or with a large one, the join strategy is left to the
    optimizer, which measures shuffle output at run time.
    """
    if rows is not None and rows <= BROADCAST_ROWS:
        return F.broadcast(df)
    return df


def tasks_for(rows: int) -> int:
    """Tasks of about ``TASK_ROWS`` rows each."""
    return max(1, -(-rows // TASK_ROWS))


def has_at_most(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows of ``size`` bytes in all.

    One aggregation without a shuffle of rows: the lengths of texts, 16 bytes for
    each other value.
    """
    plain = 16 * len(df.columns)
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    width = reduce(add, texts, F.lit(plain)).cast("long")
    found = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return found["rows"] <= rows and found["bytes"] <= size


def shared_folder(spark: SparkSession) -> str:
    """The folder that the whole cluster shares: the session's ``spark.checkpoint.dir``.

    Only a local session without one (tests) gets a temporary folder.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="siegelog-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared_folder(spark)}/siegelog/{name}-{uuid.uuid4().hex}"


def stored_copy(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder and read back: evaluated once, and of a size the planner knows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the folder shared by the cluster."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
