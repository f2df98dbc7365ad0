"""Ready-made reports over the fact and the overall statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siegelog.functions import expressions as X
from siegelog.operators.rollups import Rollups
from siegelog.operators.sets import overlap
from siegelog.operators.topn import largest, largest_per_group, only
from siegelog.plans.filters import Filters, rows_of
from siegelog.plans.volatility import most_volatile
from siegelog.schema import ENTITY


# The port of interest and the names of its two groups.
SSH_PORT = 22
SSH_LABEL = "SSH (Port 22)"
OTHER_LABEL = "Other Ports"


def total_count(attacks: DataFrame) -> DataFrame:
    return attacks.agg(F.count("*").alias("total_attacks"))


def by_label(attacks: DataFrame, label: str, n: int | None = None) -> DataFrame:
    """Attacks and distinct addresses per label, largest first."""
    sums = (
        attacks.filter(X.present(label))
        .groupBy(label)
        .agg(F.count("*").alias("attacks"), F.count_distinct("ip").alias("unique_ips"))
        .orderBy(F.desc("attacks"), F.asc(label))
    )
    return sums if n is None else sums.limit(n)


def head(stats: DataFrame, metric: str, key: str, columns: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of a statistics table by ``metric``, largest first."""
    return stats.orderBy(F.desc(metric), F.asc(key)).limit(n).select(*columns)


def latest_days(stats: DataFrame, n: int = 30) -> DataFrame:
    return (
        stats.orderBy(F.desc("date"))
        .limit(n)
        .select(X.day_text("date").alias("date"), "total_attacks", "unique_ips")
    )


def share_of_total(sums: DataFrame, metric: str, name: str = "percentage") -> DataFrame:
    """Adds the percentage of each row in the sum of ``metric``.

    For tables of a handful of groups, which a window may hold in one task.
    """
    total = F.sum(metric).over(Window.partitionBy())
    return sums.withColumn(name, X.round_half_up(X.percent(metric, total), 2))


def hourly_share(hours: DataFrame) -> DataFrame:
    """Hours of the day (24 rows at most) with their share."""
    return share_of_total(hours, "attack_count").orderBy("hour")


def port_share(attacks: DataFrame) -> DataFrame:
    """Attacks on port 22 and on all others (two rows at most) with their share."""
    port = F.when(F.col("port") == SSH_PORT, SSH_LABEL).otherwise(OTHER_LABEL)
    sums = attacks.groupBy(port.alias("port_type")).agg(F.count("*").alias("attacks"))
    return share_of_total(sums, "attacks")


def weekly_trend(stats: DataFrame, n: int = 12) -> DataFrame:
    """Attacks and mean daily addresses of the last ``n`` weeks (from Monday)."""
    return (
        stats.groupBy(F.trunc("date", "week").alias("week"))
        .agg(F.sum("total_attacks").alias("attacks"), F.avg("unique_ips").alias("avg_daily_ips"))
        .orderBy(F.desc("week"))
        .limit(n)
        .withColumn("week", X.day_text("week"))
    )


def top_entities(rollups: Rollups, dim: str, filters: Filters, n: int = 10) -> DataFrame:
    facts = rows_of(getattr(rollups, dim), filters, filters.given())
    return largest(facts, ENTITY[dim], n)


def networks_of_countries(
    rollups: Rollups, filters: Filters, countries: DataFrame, count: int, networks: int = 10
) -> DataFrame:
    """The largest networks of each of the given countries, summed over the countries.

    ``count`` is the bound of the number of ``countries``.
    """
    facts = only(rows_of(rollups.asn, filters, ()), countries, "country", count)
    return (
        largest_per_group(facts, "country", "asn_name", networks)
        .groupBy("asn_name")
        .agg(F.sum("attacks").alias("attacks"))
        .orderBy(F.desc("attacks"), F.asc("asn_name"))
    )


def volume_vs_volatility(
    rollups: Rollups, dim: str, filters: Filters, n: int = 10
) -> DataFrame:
    """Which of the largest and of the most volatile entities are both."""
    entity = ENTITY[dim]
    facts = rows_of(getattr(rollups, dim), filters, filters.given())
    lists = overlap(largest(facts, entity, n), most_volatile(facts, entity, n), entity)
    side = F.col("membership")
    return lists.select(
        entity,
        F.when(side == "only_a", "only_volume")
        .when(side == "only_b", "only_volatility")
        .otherwise(side)
        .alias("membership"),
    )
