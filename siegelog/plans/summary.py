"""One row of metrics per entity over a period."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siegelog.functions import expressions as X
from siegelog.functions.dates import days_between, to_day
from siegelog.functions.scale import broadcast_if_bounded
from siegelog.operators.rollups import Rollups
from siegelog.operators.topn import largest
from siegelog.plans.volatility import NOT_A_COUNTRY
from siegelog.schema import ENTITY

RECENT_DAYS = 7

# Dimensions whose absent days count as days with 0 attacks.
ON_CALENDAR = ("country", "asn")


def entity_summary(
    rollups: Rollups,
    dim: str,
    start: str | dt.date,
    end: str | dt.date,
    limit: int | None = None,
    offset: int = 0,
    total_days: int | None = None,
) -> DataFrame:
    """Totals, extremes, changes, persistence and recency of every entity of ``dim``.

    For countries and networks a day without attacks is a day with 0, so it
    takes part in the changes; addresses and usernames compare present days
    only. Their recent attacks also look before ``start`` when the period is
    shorter than a week. ``limit`` and ``offset`` page by total attacks;
    ``total_days`` replaces the length of the period in the persistence.
    """
    start, end = to_day(start), to_day(end)
    entity = ENTITY[dim]
    calendar_days = dim in ON_CALENDAR
    recent_from = end - dt.timedelta(days=RECENT_DAYS - 1)
    first_needed = start if calendar_days else min(start, recent_from)

    known = F.col(entity).isNotNull()
    if dim == "country":
        known = known & (F.col(entity) != NOT_A_COUNTRY)
    table = getattr(rollups, dim).filter(known)
    in_period = F.col("date").between(F.lit(start), F.lit(end))
    if limit is not None or offset:
        page = largest(table.filter(in_period), entity, limit, offset)
        table = table.join(
            broadcast_if_bounded(page.select(entity), limit), entity, "left_semi"
        )
    facts = table.filter(F.col("date").between(F.lit(first_needed), F.lit(end)))

    days = facts.groupBy(entity, "date").agg(F.sum("attacks").alias("attacks"))
    changes = _calendar_changes if calendar_days else _present_changes
    metrics = (
        changes(days, entity, start, end)
        .groupBy(entity)
        .agg(*_metrics(start, end, max(recent_from, first_needed)))
        .filter(F.col("active_days") > 0)
    )
    extras = _extras(facts.filter(in_period), dim, entity)
    if extras is not None:
        metrics = metrics.join(extras, entity, "left")

    persistence = X.percent("active_days", F.lit(total_days or days_between(start, end)))
    columns = [
        entity,
        "total_attacks",
        X.round_half_up("avg_daily", 2).alias("avg_daily"),
        X.day_text("first_seen").alias("first_seen"),
        X.day_text("last_seen").alias("last_seen"),
        "max_daily",
        F.coalesce("max_absolute_change", F.lit(0).cast("bigint")).alias("max_absolute_change"),
        F.coalesce(X.round_half_up("max_pct_change", 2), F.lit(0.0)).alias("max_pct_change"),
        X.round_half_up(persistence, 1).alias("persistence_pct"),
        F.coalesce("recent_attacks", F.lit(0).cast("bigint")).alias("recent_attacks"),
        "active_days",
    ]
    columns += [c for c in metrics.columns if c in ("country", "asn_name", "countries") and c != entity]
    return metrics.select(*columns).orderBy(F.desc("total_attacks"), F.asc(entity))


def _metrics(start: dt.date, end: dt.date, recent_from: dt.date) -> list[Column]:
    inside = F.col("date") >= F.lit(start)
    attacks = F.when(inside, F.col("attacks"))
    return [
        F.sum(attacks).alias("total_attacks"),
        F.avg(attacks).alias("avg_daily"),
        F.min(F.when(inside, F.col("date"))).alias("first_seen"),
        F.max(F.when(inside, F.col("date"))).alias("last_seen"),
        F.max(attacks).alias("max_daily"),
        F.max("absolute_change").alias("max_absolute_change"),
        F.max("pct_change").alias("max_pct_change"),
        F.sum(F.when(F.col("date") >= F.lit(recent_from), F.col("attacks"))).alias(
            "recent_attacks"
        ),
        F.count(attacks).alias("active_days"),
    ]


def _present_changes(days: DataFrame, entity: str, start: dt.date, end: dt.date) -> DataFrame:
    """Changes between present days of the period."""
    order = Window.partitionBy(entity).orderBy("date")
    previous = F.when(
        F.lag("date").over(order) >= F.lit(start), F.lag("attacks").over(order)
    )
    return days.withColumn("previous", previous).select(
        entity,
        "date",
        "attacks",
        (F.col("attacks") - F.col("previous")).alias("absolute_change"),
        X.change_pct_from_one(F.col("attacks"), F.col("previous")).alias("pct_change"),
    )


def _calendar_changes(days: DataFrame, entity: str, start: dt.date, end: dt.date) -> DataFrame:
    """Greatest changes of the full calendar, told from the present days alone.

    A grid of days x entities would be nearly all zeros. Next to a present day
    with ``a`` attacks these changes of the grid can occur:

    - the day itself against its previous day: present, 0, or none on ``start``;
    - the day after, when absent: from ``a`` to 0;
    - a second absent day in a row, before, between or after: from 0 to 0.

    Each row carries the greatest of them, so the maximum per entity is that of
    the grid.
    """
    order = Window.partitionBy(entity).orderBy("date")
    first, last, zero = F.lit(start), F.lit(end), F.lit(0).cast("bigint")
    before = F.lag("date").over(order)
    after = F.lead("date").over(order)
    known = days.withColumns(
        {"before": before, "after": after, "p": F.lag("attacks").over(order)}
    )
    a, date = F.col("attacks"), F.col("date")
    gap = F.datediff(date, "before")
    previous = (
        F.when(gap == 1, F.col("p"))
        .when(F.col("before").isNotNull() | (date > first), zero)
    )
    falls = (date < last) & (F.col("after").isNull() | (F.datediff("after", date) > 1))
    idle = (
        (F.col("before").isNull() & (F.datediff(date, first) >= 2))
        | (gap >= 3)
        | (F.col("after").isNull() & (F.datediff(last, date) >= 2))
    )
    return known.select(
        entity,
        "date",
        "attacks",
        F.greatest(a - previous, F.when(falls, zero - a), F.when(idle, zero)).alias(
            "absolute_change"
        ),
        F.greatest(
            X.change_pct_from_one(a, previous),
            F.when(falls, X.change_pct_from_one(zero, a)),
            F.when(idle, X.change_pct_from_one(zero, zero)),
        ).alias("pct_change"),
    )


def _extras(facts: DataFrame, dim: str, entity: str) -> DataFrame | None:
    if dim == "ip":
        return facts.groupBy(entity).agg(
            F.mode("country", True).alias("country"), F.mode("asn_name", True).alias("asn_name")
        )
    if dim in ("asn", "username"):
        return facts.groupBy(entity).agg(F.count_distinct("country").alias("countries"))
    return None


def entity_counts(rollups: Rollups, start: str | dt.date, end: str | dt.date) -> DataFrame:
    """Number of distinct entities of every dimension in the period, one row each."""
    return _counts(rollups, start, end, F.count_distinct)


def approximate_entity_counts(
    rollups: Rollups, start: str | dt.date, end: str | dt.date, rsd: float = 0.02
) -> DataFrame:
    """The same from sketches, without shuffling the entities."""
    return _counts(rollups, start, end, lambda c: F.approx_count_distinct(c, rsd))


def _counts(rollups: Rollups, start: str | dt.date, end: str | dt.date, how) -> DataFrame:
    parts = [
        getattr(rollups, dim)
        .filter(F.col("date").between(F.lit(to_day(start)), F.lit(to_day(end))))
        .agg(how(entity).alias("entities"))
        .select(F.lit(dim).alias("dimension"), "entities")
        for dim, entity in ENTITY.items()
    ]
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    return counts


def distinct_partners(
    table: DataFrame, entity: str, partner: str, start: str | dt.date, end: str | dt.date
) -> DataFrame:
    """How many distinct ``partner`` values each entity has in the period."""
    return (
        table.filter(
            F.col("date").between(F.lit(to_day(start)), F.lit(to_day(end)))
            & F.col(entity).isNotNull()
        )
        .groupBy(entity)
        .agg(F.count_distinct(partner).alias("partners"))
    )
