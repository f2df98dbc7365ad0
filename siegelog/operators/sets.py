"""Comparison of entity lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_top(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of two lists that are not in both: ``key, side`` with ``only_a`` or ``only_b``.

    No rows: the lists agree. Repeated keys count.
    """
    left, right = a.select(key), b.select(key)
    return (
        left.exceptAll(right)
        .withColumn("side", F.lit("only_a"))
        .unionByName(right.exceptAll(left).withColumn("side", F.lit("only_b")))
    )


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of two lists of distinct keys: ``key, membership`` of both, only_a or only_b."""
    marked = (
        a.select(key, F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
        .unionByName(b.select(key, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
        .groupBy(key)
        .agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    )
    return marked.select(
        key,
        F.when(F.col("in_a") + F.col("in_b") == 2, "both")
        .when(F.col("in_a") == 1, "only_a")
        .otherwise("only_b")
        .alias("membership"),
    )
