"""All stored tables of a log, and their names in SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from siegelog.operators import rollups as R
from siegelog.operators.rollups import Rollups
from siegelog.plans.volatility import country_volatility, volatility_summary
from siegelog.schema import ENTITY

# Names under which the daily rollups are registered.
DAILY_NAMES = {
    "stats": "daily_stats",
    "country": "daily_country_attacks",
    "asn": "daily_asn_attacks",
    "username": "daily_username_attacks",
    "ip": "daily_ip_attacks",
    "ip_username": "daily_ip_username_attacks",
}

# Rows of the two stored top lists, by definition.
STORED_TOP = 10_000

# Overall statistics, from the partials of ``fact_partials``.
OVERALL = {
    "country_stats": R.country_stats_of,
    "top_ips": partial(R.top_ips_of, limit=STORED_TOP),
    "username_stats": partial(R.username_stats_of, limit=STORED_TOP),
    "hourly_patterns": R.hourly_patterns_of,
}

VOLATILE_NAMES = {dim: f"volatile_{dim}_summary" for dim in ENTITY}


def build(attacks: DataFrame, path: str) -> Rollups:
    """Write the daily rollups, the overall statistics and the volatility tables.

    The fact is scanned once, for the partials of both kinds, which are stored.
    """
    spark = attacks.sparkSession
    R.fact_partials(attacks).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/partials")
    partials = spark.read.parquet(f"{path}/partials")
    daily = partials.filter("kind = 'daily'").select(*R.BASE_KEYS, "attacks")
    rollups = Rollups.build_from_base(daily, path)
    overall = partials.filter("kind = 'overall'")
    for name, statistic in OVERALL.items():
        _write(statistic(overall), f"{path}/{name}")
    for dim, name in VOLATILE_NAMES.items():
        _write(volatility_summary(rollups, dim), f"{path}/{name}")
    _write(country_volatility(rollups), f"{path}/country_volatility")
    return rollups


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def register(spark: SparkSession, path: str) -> Rollups:
    """Temporary views of everything ``build`` wrote, for ad-hoc SQL."""
    rollups = Rollups.read(spark, path)
    for field, name in DAILY_NAMES.items():
        getattr(rollups, field).createOrReplaceTempView(name)
    for name in (*OVERALL, *VOLATILE_NAMES.values(), "country_volatility"):
        spark.read.parquet(f"{path}/{name}").createOrReplaceTempView(name)
    return rollups
