"""Sets of entities as stored bitmaps: distinct counts that merge and stay exact.

Entities are numbered once. A day's set is a bitmap for every 32,768 numbers, so a
union over any days is ``bitmap_or_agg`` by bucket and its size a sum of bit counts:
neither the log nor the entities are read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siegelog.functions.scale import reliable_checkpoint
from siegelog.operators.joins import lookup_join
from siegelog.operators.ranking import with_position


def number_entities(entities: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """``key, number`` of every distinct value, from 1 without gaps; NULL has no number.

    Numbers of ``known`` (an earlier result) stay as they are, new values follow them.
    """
    values = entities.select(key).filter(F.col(key).isNotNull()).distinct()
    if known is None:
        return with_position(values, [F.asc(key)]).withColumnRenamed("position", "number")
    fresh = with_position(values.join(known, key, "left_anti"), [F.asc(key)])
    last = known.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    return known.select(key, "number").unionByName(
        fresh.select(key, (F.col("position") + F.lit(last)).alias("number"))
    )


def bitmaps(rows: DataFrame, numbers: DataFrame, key: str, groups: list[str]) -> DataFrame:
    """``groups, bucket, bits``: the entities of every group; rows without an entity are left out."""
    pairs = rows.filter(F.col(key).isNotNull()).select(*groups, key).distinct()
    placed = lookup_join(pairs, numbers, key, unique=True).filter(F.col("number").isNotNull())
    return placed.groupBy(*groups, F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")
    )


def united(sets: DataFrame, *groups: str | Column) -> DataFrame:
    """The union of sets, by group."""
    return sets.groupBy(*groups, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def sizes(sets: DataFrame, *groups: str, name: str = "entities") -> DataFrame:
    """Number of entities of every group of ``united`` sets."""
    return sets.groupBy(*groups).agg(
        F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("bigint").alias(name)
    )


def _in_range(start: str | None, end: str | None) -> Column:
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        inside = inside & (F.col("date") <= F.lit(end).cast("date"))
    return inside


@dataclass(frozen=True)
class EntitySets:
    """Stored numbers and daily bitmaps of one kind of entity, by further columns if wanted."""

    path: str
    key: str
    groups: tuple[str, ...] = ()

    def numbers(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/numbers")

    def daily(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/daily")

    def build(self, rollup: DataFrame) -> EntitySets:
        """From a daily rollup (``date``, the entity, the groups)."""
        number_entities(rollup, self.key).write.mode("overwrite").parquet(f"{self.path}/numbers")
        self._store(rollup)
        return self

    def refresh(self, rollup: DataFrame) -> EntitySets:
        """Replace the days present in ``rollup``; new entities get the next numbers."""
        known = self.numbers(rollup.sparkSession)
        numbers = reliable_checkpoint(number_entities(rollup, self.key, known))
        numbers.write.mode("overwrite").parquet(f"{self.path}/numbers")
        self._store(rollup)
        return self

    def _store(self, rollup: DataFrame) -> None:
        numbers = self.numbers(rollup.sparkSession)
        sets = bitmaps(rollup.filter(F.col("date").isNotNull()), numbers, self.key, ["date", *self.groups])
        (
            sets.hint("rebalance", F.col("date"))
            .sortWithinPartitions("date", *self.groups, "bucket")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("date")
            .parquet(f"{self.path}/daily")
        )

    def unique(self, spark: SparkSession, start: str | None = None, end: str | None = None) -> DataFrame:
        """Distinct entities of a range of days, by the groups: one row without groups."""
        chosen = self.daily(spark).filter(_in_range(start, end))
        return sizes(united(chosen, *self.groups), *self.groups)

    def unique_by(
        self, spark: SparkSession, period: Column, start: str | None = None, end: str | None = None
    ) -> DataFrame:
        """``period`` and the distinct entities in it, such as weeks: ``F.trunc("date", "week")``."""
        chosen = self.daily(spark).filter(_in_range(start, end)).withColumn("period", period)
        return sizes(united(chosen, "period", *self.groups), "period", *self.groups)

    def returning(self, spark: SparkSession, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
        """Entities of two ranges: ``both, only_first, only_second`` by the groups."""
        daily = self.daily(spark)
        a = united(daily.filter(_in_range(*first)), *self.groups).withColumn("side", F.lit("a"))
        b = united(daily.filter(_in_range(*second)), *self.groups).withColumn("side", F.lit("b"))
        of = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.bitmap_count("bits"))), F.lit(0))
        either = a.unionByName(b).groupBy(*self.groups, "bucket").agg(
            of("a").alias("n_a"), of("b").alias("n_b"), F.bitmap_count(F.bitmap_or_agg("bits")).alias("n")
        )
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
        return either.groupBy(*self.groups).agg(
            total(F.col("n_a") + F.col("n_b") - F.col("n")).alias("both"),
            total(F.col("n") - F.col("n_b")).alias("only_first"),
            total(F.col("n") - F.col("n_a")).alias("only_second"),
        )
