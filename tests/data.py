"""Hand-built rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from siegelog.operators.rollups import Rollups

ATTACK = (
    "datetime timestamp_ntz, ip string, country string, asn string, asn_name string, "
    "username string"
)


def attacks(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """``(day, ip, country, asn_name, username, count)`` as that many log rows."""
    return spark.createDataFrame(
        [
            (
                dt.datetime.fromisoformat(day),
                ip,
                country,
                None if network is None else f"AS-{network}",
                network,
                username,
            )
            for day, ip, country, network, username, count in rows
            for _ in range(count)
        ],
        ATTACK,
    )


def rollups(spark: SparkSession, rows: list[tuple]) -> Rollups:
    return Rollups.of(attacks(spark, rows))


def tuples(df: DataFrame, *columns: str) -> list[tuple]:
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
