"""Summaries and volatility of any range of days from stored blocks of days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siegelog.functions import expressions as X
from siegelog.functions.dates import days_between, to_day
from siegelog.operators.rollups import Rollups
from siegelog.operators.spans import DayBlocks
from siegelog.plans.summary import ON_CALENDAR, RECENT_DAYS
from siegelog.plans.volatility import NOT_A_COUNTRY
from siegelog.schema import ENTITY


def entity_days(rollups: Rollups, dim: str) -> DataFrame:
    """``entity, date, attacks`` of a dimension, as the summaries count them."""
    entity = ENTITY[dim]
    table = getattr(rollups, dim).filter(F.col(entity).isNotNull())
    if dim == "country":
        table = table.filter(F.col(entity) != NOT_A_COUNTRY)
    return table.groupBy(entity, "date").agg(F.sum("attacks").alias("attacks"))


def levels_for(days: int) -> int:
    """Levels of blocks that keep a range of so many days in few blocks."""
    return max(0, days - 1).bit_length()


def build_blocks(rollups: Rollups, dim: str, path: str, days: int) -> DayBlocks:
    """Stored blocks of a dimension, up to the length of ``days``."""
    return DayBlocks(path, ENTITY[dim], levels_for(days)).build(entity_days(rollups, dim))


def _with_edges(start: dt.date, end: dt.date) -> tuple[Column, Column]:
    """Greatest changes of the full calendar: those between present days, and the absent days at both ends."""
    zero, first, last = F.lit(0).cast("bigint"), F.col("first_attacks"), F.col("last_attacks")
    lead, trail = F.datediff("first_day", F.lit(start)), F.datediff(F.lit(end), "last_day")
    idle = (lead >= 2) | (trail >= 2)
    rise = F.greatest(
        "calendar_rise", F.when(lead >= 1, first), F.when(trail >= 1, zero - last), F.when(idle, zero)
    )
    pct = F.greatest(
        "calendar_pct",
        F.when(lead >= 1, X.change_pct_from_one(first, zero)),
        F.when(trail >= 1, X.change_pct_from_one(zero, last)),
        F.when(idle, X.change_pct_from_one(zero, zero)),
    )
    return rise, pct


def block_summary(
    spark: SparkSession, blocks: DayBlocks, dim: str, start: str | dt.date, end: str | dt.date, total_days: int | None = None
) -> DataFrame:
    """The ten metrics of ``entity_summary`` for any range, from O(log n) stored blocks."""
    start, end = to_day(start), to_day(end)
    entity, calendar_days = ENTITY[dim], dim in ON_CALENDAR
    recent_from = end - dt.timedelta(days=RECENT_DAYS - 1)
    if calendar_days:
        recent_from = max(start, recent_from)
    state = blocks.over(spark, start, end)
    recent = (
        blocks.states(spark, recent_from, end).groupBy(entity).agg(F.sum("total_attacks").alias("recent_attacks"))
    )
    rise, pct = _with_edges(start, end) if calendar_days else (F.col("rise"), F.col("rise_pct"))
    mean = F.col("total_attacks").cast("double") / F.col("active_days")
    persistence = X.percent("active_days", F.lit(total_days or days_between(start, end)))
    return (
        state.join(recent, entity, "left")
        .select(
            entity,
            "total_attacks",
            X.round_half_up(mean, 2).alias("avg_daily"),
            X.day_text("first_day").alias("first_seen"),
            X.day_text("last_day").alias("last_seen"),
            "max_daily",
            F.coalesce(rise, F.lit(0).cast("bigint")).alias("max_absolute_change"),
            F.coalesce(X.round_half_up(pct, 2), F.lit(0.0)).alias("max_pct_change"),
            X.round_half_up(persistence, 1).alias("persistence_pct"),
            F.coalesce("recent_attacks", F.lit(0).cast("bigint")).alias("recent_attacks"),
            "active_days",
        )
        .orderBy(F.desc("total_attacks"), F.asc(entity))
    )


def block_volatility(spark: SparkSession, blocks: DayBlocks, start: str | dt.date, end: str | dt.date) -> DataFrame:
    """``volatility_summary`` of any range: the greatest change and its (first) day."""
    state = blocks.over(spark, to_day(start), to_day(end))
    return state.filter(F.col("moves") > 0).select(
        blocks.entity,
        F.col("peak.size").alias("max_volatility"),
        X.day_text("peak.date").alias("max_change_date"),
        F.col("peak.attacks").alias("attacks_on_max"),
        F.col("peak.previous").alias("prev_attacks_on_max"),
    )


def block_spread(
    spark: SparkSession, blocks: DayBlocks, start: str | dt.date, end: str | dt.date, n: int = 20
) -> DataFrame:
    """``country_volatility`` of any range: mean, spread, count and maximum of the changes of the ``n`` largest."""
    state = blocks.over(spark, to_day(start), to_day(end))
    largest = state.orderBy(F.desc("total_attacks"), F.asc(blocks.entity)).limit(n)
    count, mean = F.col("moves"), F.col("sum_size") / F.col("moves")
    squares = F.greatest(F.col("sum_square") - F.col("sum_size") * mean, F.lit(0.0))
    return largest.filter(count > 0).select(
        blocks.entity,
        mean.alias("avg_volatility"),
        F.when(count > 1, F.sqrt(squares / (count - 1))).alias("volatility_stddev"),
        count.alias("days_measured"),
        F.col("peak.size").alias("max_change"),
    )
