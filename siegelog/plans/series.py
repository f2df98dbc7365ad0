"""Daily series per dimension under any combination of filters.

All series are one plan: choose a rollup, filter it, pick the entities (none,
the given ones, or the largest), add an empty row per entity and day, and sum
by day and entity. Which rollup, filters and label apply is a table, `RULES`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siegelog.functions import expressions as X
from siegelog.functions.dates import calendar, days_between, with_every_day
from siegelog.operators.rollups import Rollups
from siegelog.operators.topn import largest, only
from siegelog.plans.filters import Filters, route, rows_of
from siegelog.schema import ENTITY

ALL = ("username", "ip", "country", "asn")

# Shapes of a series.
STORED = "stored"  # rows as stored, days without attacks stay absent
TOTAL = "total"  # one line
GIVEN = "given"  # one line per value of the dimension's own filter
TOP = "top"  # one line per largest entity
LOOKUP = "lookup"  # one line per address, labelled with its country


@dataclass(frozen=True)
class Rule:
    """How to answer when at least the filters ``needs`` are set."""

    needs: tuple[str, ...]
    table: str  # name of the rollup, or "route"
    uses: tuple[str, ...]  # filters that apply; others are ignored
    shape: str
    label: str | None = None  # country of the day if there is one, else this text
    fixed_label: str | None = None  # this text on every row


# Which filters select which table, and the labels "Unknown",
# "Mixed" and "Single IP". First match wins. A label of "{country}" is the country asked for.
RULES: dict[str, tuple[Rule, ...]] = {
    "total": (
        Rule(("username",), "ip_username", ALL, TOTAL),
        Rule(("ip",), "ip", ("ip",), TOTAL),
        Rule(("asn", "country"), "asn", ("asn", "country"), TOTAL),
        Rule(("country",), "country", ("country",), STORED),
        Rule(("asn",), "asn", ("asn",), TOTAL),
        Rule((), "stats", (), STORED),
    ),
    "country": (
        Rule(("username", "country"), "ip_username", ALL, GIVEN),
        Rule(("username",), "ip_username", ALL, TOP),
        Rule(("ip",), "ip", ("ip",), LOOKUP),
        Rule(("asn", "country"), "asn", ("asn", "country"), GIVEN),
        Rule(("country",), "country", ("country",), STORED),
        Rule(("asn",), "asn", ("asn",), TOP),
        Rule((), "country", (), TOP),
    ),
    "ip": (
        Rule(("username", "ip"), "ip_username", ALL, GIVEN, label="Unknown"),
        Rule(("username",), "ip_username", ALL, TOP, label="Mixed"),
        Rule(("ip",), "ip", ("ip",), GIVEN, label="Unknown"),
        Rule(("asn", "country"), "ip", ("asn", "country"), TOP, label="{country}"),
        Rule(("country",), "ip", ("country",), TOP, label="{country}"),
        Rule(("asn",), "ip", ("asn",), TOP, label="Mixed"),
        Rule((), "ip", (), TOP, label="Mixed"),
    ),
    "username": (
        Rule(("username",), "ip_username", ALL, GIVEN, label="Mixed"),
        Rule(("ip",), "ip_username", ("ip",), TOP, fixed_label="Single IP"),
        Rule(("asn", "country"), "username", ("asn", "country"), TOP, fixed_label="{country}"),
        Rule(("country",), "username", ("country",), TOP, fixed_label="{country}"),
        Rule(("asn",), "username", ("asn",), TOP, fixed_label="Mixed"),
        Rule((), "username", (), TOP, fixed_label="Mixed"),
    ),
    "asn": (
        Rule(("asn",), "route", ALL, GIVEN, label="Mixed"),
        Rule((), "route", ALL, TOP, label="Mixed"),
    ),
}


def rule_for(rules: tuple[Rule, ...], filters: Filters) -> Rule:
    given = filters.given()
    return next(rule for rule in rules if given.issuperset(rule.needs))


def source(rollups: Rollups, dim: str, rule: Rule, filters: Filters) -> DataFrame:
    """The rollup a rule reads, all days."""
    name = route(dim, filters.given()) if rule.table == "route" else rule.table
    return getattr(rollups, name)


def series(
    rollups: Rollups, dim: str, filters: Filters, n: int = 10, fill: bool | None = None
) -> DataFrame:
    """``date, [entity, country,] attacks`` for ``dim`` (or "total").

    ``fill`` overrides whether days without attacks appear with 0.
    """
    rule = rule_for(RULES[dim], filters)
    table = source(rollups, dim, rule, filters)
    filled = rule.shape != STORED if fill is None else fill
    days = days_between(filters.start, filters.end)
    if rule.table == "stats":
        table = table.select("date", F.col("total_attacks").alias("attacks"))

    if rule.shape == LOOKUP:
        found = address_days(table, filters)
        found = found if filled else found.filter(F.col("attacks").isNotNull())
        return _finish(found, ["country"], None)

    facts = rows_of(table, filters, rule.uses)
    if dim == "total":
        empty = calendar(table.sparkSession, filters.start, filters.end) if filled else None
        return _finish(by_day(facts, empty, []), [], days)

    entity = ENTITY[dim]
    lines, facts = chosen_lines(facts, dim, rule, filters, n)
    empty = with_every_day(lines, filters.start, filters.end) if filled else None
    count = n if rule.shape == TOP else len(getattr(filters, dim))
    rows = by_day(facts, empty, [entity], with_country=rule.label is not None)
    if rule.label is not None:
        rows = rows.withColumn(
            "country", F.coalesce("country", F.lit(label_text(rule.label, filters)))
        )
    elif rule.fixed_label is not None:
        rows = rows.withColumn("country", F.lit(label_text(rule.fixed_label, filters)))
    return _finish(rows, [entity], days * count)


def chosen_lines(
    facts: DataFrame, dim: str, rule: Rule, filters: Filters, n: int
) -> tuple[DataFrame, DataFrame]:
    """The entities to draw, one row each, and their facts."""
    entity = ENTITY[dim]
    if rule.shape == TOP:
        top = largest(facts, entity, n).select(entity)
        return top, only(facts, top, entity, n)
    values = getattr(filters, dim)
    return given_lines(facts, entity, values), facts


def given_lines(facts: DataFrame, entity: str, values: tuple[str, ...]) -> DataFrame:
    array = F.array(*[F.lit(v) for v in values])
    return facts.sparkSession.range(1).select(F.explode(array).alias(entity))


def by_day(
    facts: DataFrame,
    empty: DataFrame | None,
    entities: list[str],
    with_country: bool = False,
) -> DataFrame:
    """Facts summed to (date, entity); ``empty`` lists the rows that must appear.

    An empty row carries NULL attacks, so after the sum a NULL marks a day
    without facts. Adding rows before the aggregation takes the place of an
    outer join. ``with_country`` adds the last country of the day by name; it
    is picked after a hash aggregation, as the greatest of a text would have
    Spark sort the facts.
    """
    keys = ["date", *entities]
    rows = facts
    if empty is not None:
        rows = facts.unionByName(empty, allowMissingColumns=True)
    attacks = F.sum("attacks").alias("attacks")
    if not with_country:
        return rows.groupBy(*keys).agg(attacks)
    return (
        rows.groupBy(*keys, "country")
        .agg(attacks)
        .groupBy(*keys)
        .agg(attacks, F.max("country").alias("country"))
    )


def address_days(table: DataFrame, filters: Filters) -> DataFrame:
    """Rows of the given addresses, one at least per day, with a country label.

    A day without rows has NULL attacks and the address's own country (the
    first by name). An address that never occurs gives no rows at all.
    """
    rows = table.filter(filters.matches(["ip"]))
    known = rows.groupBy("ip").agg(F.min("country").alias("home"))
    grid = with_every_day(known, filters.start, filters.end)
    days = rows.filter(filters.in_range()).select("ip", "date", "country", "attacks")
    return grid.join(days, ["ip", "date"], "left").select(
        "ip", "date", F.coalesce("country", "home").alias("country"), "attacks"
    )


def label_text(label: str, filters: Filters) -> str:
    if label != "{country}":
        return label
    return filters.country[0] if len(filters.country) == 1 else "Mixed"


def _finish(rows: DataFrame, entities: list[str], bound: int | None) -> DataFrame:
    """Final columns and order; ``bound`` is the greatest possible number of rows."""
    columns = [X.day_text("date").alias("date"), *entities]
    if "country" in rows.columns and "country" not in entities:
        columns.append("country")
    columns.append(F.coalesce(F.col("attacks"), F.lit(0).cast("bigint")).alias("attacks"))
    return rows.select(*columns).orderBy("date", F.desc("attacks"), *entities)


def series_totals(lines: DataFrame, entity: str) -> DataFrame:
    """Series by their total, as a legend lists them."""
    return (
        lines.groupBy(entity)
        .agg(F.sum("attacks").alias("total"))
        .orderBy(F.desc("total"), F.asc(entity))
    )


def series_excluding(lines: DataFrame, entity: str, hidden: list[str]) -> DataFrame:
    """The greatest daily value of every series that is not hidden."""
    return (
        lines.filter(~F.col(entity).isin(*hidden) if hidden else F.lit(True))
        .groupBy(entity)
        .agg(F.max("attacks").alias("max_attacks"))
        .orderBy(F.asc(entity))
    )


def visible_maximum(lines: DataFrame, entity: str, hidden: list[str]) -> DataFrame:
    """The greatest daily value over all series that are not hidden, one row."""
    return lines.filter(~F.col(entity).isin(*hidden) if hidden else F.lit(True)).agg(
        F.max("attacks").alias("max_attacks")
    )
