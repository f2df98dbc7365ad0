"""Day-over-day change: summaries per entity and series of the most volatile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from siegelog.functions import expressions as X
from siegelog.functions.dates import days_between, with_every_day
from siegelog.operators.rollups import Rollups
from siegelog.operators.topn import largest, only
from siegelog.plans.filters import Filters, rows_of
from siegelog.plans.series import (
    GIVEN,
    LOOKUP,
    TOP,
    Rule,
    address_days,
    by_day,
    given_lines,
    rule_for,
    source,
)
from siegelog.schema import ENTITY

NOT_A_COUNTRY = "Unknown"

RULES: dict[str, tuple[Rule, ...]] = {
    "country": (
        Rule(("ip",), "ip", ("ip",), LOOKUP),
        Rule(("username",), "ip_username", ("username",), TOP),
        Rule(("asn", "country"), "asn", ("asn", "country"), GIVEN),
        Rule(("country",), "country", ("country",), GIVEN),
        Rule(("asn",), "asn", ("asn",), TOP),
        Rule((), "country", (), TOP),
    ),
    "asn": (
        Rule(("asn",), "route", ("username", "ip", "country", "asn"), GIVEN),
        Rule((), "route", ("username", "ip", "country"), TOP),
    ),
}


def changes(facts: DataFrame, entity: str) -> DataFrame:
    """Change of every present day against the previous present day.

    ``entity, date, attacks, prev_attacks, pct_change``; the first day of an
    entity has no change and no row. A window holds one entity's days.
    """
    days = (
        facts.filter(F.col(entity).isNotNull())
        .groupBy(entity, "date")
        .agg(F.sum("attacks").alias("attacks"))
    )
    order = Window.partitionBy(entity).orderBy("date")
    return (
        days.withColumn("prev_attacks", F.lag("attacks").over(order))
        .filter(F.col("prev_attacks").isNotNull())
        .withColumn("pct_change", X.change_pct_or_zero(F.col("attacks"), F.col("prev_attacks")))
    )


def _real_entities(table: DataFrame, dim: str) -> DataFrame:
    return table.filter(F.col("country") != NOT_A_COUNTRY) if dim == "country" else table


def volatility_summary(rollups: Rollups, dim: str) -> DataFrame:
    """The greatest change in either direction per entity, and its (first) day."""
    entity = ENTITY[dim]
    moves = changes(_real_entities(getattr(rollups, dim), dim), entity)
    at_max = F.max_by(
        F.struct("date", "attacks", "prev_attacks"),
        F.struct(F.abs("pct_change"), -F.unix_date("date")),
    )
    return (
        moves.groupBy(entity)
        .agg(F.max(F.abs("pct_change")).alias("max_volatility"), at_max.alias("at_max"))
        .select(
            entity,
            "max_volatility",
            X.day_text("at_max.date").alias("max_change_date"),
            F.col("at_max.attacks").alias("attacks_on_max"),
            F.col("at_max.prev_attacks").alias("prev_attacks_on_max"),
        )
    )


def country_volatility(rollups: Rollups, n: int = 20) -> DataFrame:
    """Mean, spread, count and maximum of the daily changes of the largest countries."""
    top = largest(rollups.country, "country", n)
    moves = changes(only(rollups.country, top, "country", n), "country")
    size = F.abs("pct_change")
    return (
        moves.groupBy("country")
        .agg(
            F.avg(size).alias("avg_volatility"),
            F.stddev_samp(size).alias("volatility_stddev"),
            F.count("*").alias("days_measured"),
            F.max(size).alias("max_change"),
        )
    )


def most_volatile(facts: DataFrame, entity: str, n: int) -> DataFrame:
    """The ``n`` entities with the greatest change; ties by name."""
    return (
        changes(facts, entity)
        .groupBy(entity)
        .agg(F.max(F.abs("pct_change")).alias("max_volatility"))
        .orderBy(F.desc("max_volatility"), F.asc(entity))
        .limit(n)
    )


def volatile_series(rollups: Rollups, dim: str, filters: Filters, n: int = 10) -> DataFrame:
    """``date, entity, attacks, pct_change`` of the most volatile entities.

    Entities are chosen by their changes between present days. The series has
    every day, and its change is against the calendar day before: 0 when that
    day has no attacks.
    """
    entity = ENTITY[dim]
    rule = rule_for(RULES[dim], filters)
    table = source(rollups, dim, rule, filters)
    if rule.shape == LOOKUP:
        rows = address_days(table, filters)
        order = Window.partitionBy("ip").orderBy("date", "country")
        return _with_change(rows, order, entity, None)

    facts = rows_of(table, filters, rule.uses)
    if rule.shape == GIVEN:
        lines, n = given_lines(facts, entity, getattr(filters, dim)), len(getattr(filters, dim))
    else:
        pool = _real_entities(facts, dim) if not filters.given() else facts
        lines = most_volatile(pool, entity, n).select(entity)
        facts = only(facts, lines, entity, n)
    rows = by_day(facts, with_every_day(lines, filters.start, filters.end), [entity])
    order = Window.partitionBy(entity).orderBy("date")
    return _with_change(rows, order, entity, n * days_between(filters.start, filters.end))


def _with_change(
    rows: DataFrame, order: WindowSpec, entity: str, bound: int | None
) -> DataFrame:
    attacks: Column = F.coalesce(F.col("attacks"), F.lit(0).cast("bigint"))
    previous = F.lag("attacks").over(order)
    change = F.coalesce(X.round_half_up(X.change_pct_or_zero(attacks, previous), 2), F.lit(0.0))
    series = rows.select(
        X.day_text("date").alias("date"),
        entity,
        attacks.alias("attacks"),
        change.alias("pct_change"),
    )
    return series.orderBy("date", F.desc("attacks"), entity)
