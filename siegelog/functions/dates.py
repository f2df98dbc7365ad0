"""Calendar helpers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def to_day(value: str | dt.date) -> dt.date:
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


def days_between(start: dt.date, end: dt.date) -> int:
    """Number of days of the closed range."""
    return (end - start).days + 1


def every_day(start: dt.date, end: dt.date) -> Column:
    """One output row per day of the closed range; none when it is empty."""
    if end < start:
        return F.explode(F.array().cast("array<date>"))
    return F.explode(F.sequence(F.lit(start), F.lit(end)))


def calendar(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    return spark.range(1).select(every_day(start, end).alias("date"))


def with_every_day(entities: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Each row of ``entities`` repeated for every day: a grid without a cross join."""
    return entities.select("*", every_day(start, end).alias("date"))
