"""Largest entities over a period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siegelog.functions import expressions as X
from siegelog.functions.scale import broadcast_if_bounded
from siegelog.operators.ranking import rows_from


def totals(facts: DataFrame, entity: str) -> DataFrame:
    """Attacks per entity; rows without an entity are left out."""
    return (
        facts.filter(F.col(entity).isNotNull())
        .groupBy(entity)
        .agg(F.sum("attacks").alias("attacks"))
    )


def largest(facts: DataFrame, entity: str, n: int | None, offset: int = 0) -> DataFrame:
    """The ``n`` entities with the most attacks, after ``offset`` others; ties by name."""
    return rows_from(totals(facts, entity), [F.desc("attacks"), F.asc(entity)], offset, n)


def only(facts: DataFrame, chosen: DataFrame, entity: str, n: int | None) -> DataFrame:
    """Rows of the chosen entities; ``n`` is the bound of their number."""
    return facts.join(broadcast_if_bounded(chosen.select(entity), n), entity, "left_semi")


def largest_per_group(facts: DataFrame, group: str, entity: str, n: int) -> DataFrame:
    """The ``n`` largest entities of every group.

    The facts are summed to one row per (group, entity) first, and the window
    drops all but ``n`` rows of a group before its shuffle, so a hot group
    costs no more than any other.
    """
    sums = (
        facts.filter(X.present(group) & X.present(entity))
        .groupBy(group, entity)
        .agg(F.sum("attacks").alias("attacks"))
    )
    order = Window.partitionBy(group).orderBy(F.desc("attacks"), F.asc(entity))
    return sums.withColumn("place", F.row_number().over(order).cast("bigint")).filter(F.col("place") <= n)
