"""Overlap of sets of entities from stored theta sketches.

Unlike a HyperLogLog sketch, a theta sketch also intersects and subtracts. Sketches are
stored by day and any further columns, so the sets of a question may be cut by any filter
on these. A set of less than 2^``lg_k`` entities is counted exactly; beyond that the
estimate of a result has a standard error of about the size of the union over
sqrt(2^``lg_k``), which is given beside it as ``error`` (three times that).
``siegelog.operators.bitmaps`` answers the same exactly where entities are numbered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K = 16


def daily_sketches(rows: DataFrame, entity: str, groups: tuple[str, ...] = (), lg_k: int = LG_K) -> DataFrame:
    """``date, groups, sketch`` of the entities of every day and group."""
    known = rows.filter(F.col(entity).isNotNull() & F.col("date").isNotNull())
    return known.groupBy("date", *groups).agg(F.theta_sketch_agg(entity, lg_k).alias("sketch"))


def united(sketches: DataFrame, chosen: Column, lg_k: int = LG_K) -> Column:
    """The union of the chosen rows, to be used in an aggregation; an empty sketch without any."""
    return F.theta_union_agg(F.when(chosen, F.col("sketch")), lg_k)


def overlap(sketches: DataFrame, first: Column, second: Column, by: tuple[str, ...] = (), lg_k: int = LG_K) -> DataFrame:
    """Entities of two selections of sketches: ``both, only_first, only_second, either, error`` by group.

    The selections are filters on the stored columns and may overlap.
    """
    sets = sketches.groupBy(*by).agg(united(sketches, first, lg_k).alias("a"), united(sketches, second, lg_k).alias("b"))
    size = lambda c: F.theta_sketch_estimate(c).cast("bigint")
    either = size(F.theta_union("a", "b", lg_k))
    error = F.when(either < (1 << lg_k), F.lit(0.0)).otherwise(either * F.lit(3.0 / (1 << lg_k) ** 0.5))
    return sets.select(
        *by,
        size(F.theta_intersection("a", "b")).alias("both"),
        size(F.theta_difference("a", "b")).alias("only_first"),
        size(F.theta_difference("b", "a")).alias("only_second"),
        either.alias("either"),
        error.alias("error"),
    )


@dataclass(frozen=True)
class SketchStore:
    """Sketches of one kind of entity and day, stored by month and sorted by date."""

    path: str
    entity: str
    groups: tuple[str, ...] = ()
    lg_k: int = LG_K

    def build(self, rollup: DataFrame) -> SketchStore:
        sketches = daily_sketches(rollup, self.entity, self.groups, self.lg_k)
        (
            sketches.withColumn("month", F.date_format("date", "yyyy-MM"))
            .hint("rebalance", F.col("month"))
            .sortWithinPartitions("month", "date", *self.groups)
            .write.mode("overwrite")
            .partitionBy("month")
            .parquet(self.path)
        )
        return self

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def overlap(self, spark: SparkSession, first: Column, second: Column, by: tuple[str, ...] = ()) -> DataFrame:
        rows = self.read(spark).filter(first | second)
        return overlap(rows, first, second, by, self.lg_k)
