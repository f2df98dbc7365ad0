"""Rollups kept up to date as files arrive.

Each micro-batch adds a partial rollup of the new files; reading adds the
partials up. A partial is stored under its batch number, so a batch that is
run again after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from siegelog import schema
from siegelog.operators.rollups import BASE_KEYS, daily_rollup, merge_rollups


def follow(
    spark: SparkSession,
    lake: str,
    target: str,
    checkpoint: str,
    keys: tuple[str, ...] = BASE_KEYS,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Process all files of the lake that were not processed before, then stop."""
    reader = spark.readStream.schema(schema.ATTACKS)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def add(batch: DataFrame, number: int) -> None:
        daily_rollup(batch, keys).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        reader.parquet(lake)
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merged(spark: SparkSession, target: str, keys: tuple[str, ...] = BASE_KEYS) -> DataFrame:
    """The rollup over all batches so far."""
    return merge_rollups(partials(spark, target).drop("batch"), keys=keys)


def partials(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target)


def fold(spark: SparkSession, target: str, folded: str, keys: tuple[str, ...] = BASE_KEYS) -> None:
    """Write the merged rollup as one table, partitioned by day."""
    (
        merged(spark, target, keys)
        .hint("rebalance", F.col("date"))
        .write.mode("overwrite")
        .partitionBy("date")
        .parquet(folded)
    )
