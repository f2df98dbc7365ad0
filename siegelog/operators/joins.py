"""Dimension lookups that stay safe on large and skewed data."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siegelog.functions.scale import BROADCAST_ROWS, has_at_most


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    *keys: str,
    right_rows: int | None = None,
    max_rows: int = BROADCAST_ROWS,
    unique: bool = False,
) -> DataFrame:
    """Left join on a ``right`` side that has one row per key.

    A right side of at most ``max_rows`` rows is broadcast, so the left side is
    not shuffled. ``right_rows`` is a known upper bound of its size; without
    one rows and bytes are measured. A larger right side takes ``skewed_join``.
    Unless the caller knows that keys are ``unique``, the job fails when one comes
    twice, as left rows would be multiplied.
    """
    if not unique:
        right = one_per_key(right, *keys)
    small = right_rows <= max_rows if right_rows is not None else has_at_most(right, max_rows)
    if not small:
        return skewed_join(left, right, *keys)
    return _left_columns_first(left.join(F.broadcast(right), list(keys), "left"), left)


def skewed_join(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Left join of two large sides where a few keys may hold most left rows.

    One left outer join, so each side is read once. Spark's skew join splits the
    left rows of a hot key over several tasks and gives each the key's right
    row. ``right`` has one row per key; ``one_per_key`` makes sure of it.
    """
    return _left_columns_first(left.join(right, list(keys), "left"), left)


def one_per_key(right: DataFrame, *keys: str) -> DataFrame:
    """``right``; its job fails if a key comes twice (but for NULL, which joins with nothing)."""
    times = F.count("*").over(Window.partitionBy(*keys))
    repeated = F.raise_error(F.concat_ws(" ", F.lit("key comes twice:"), *[F.col(k).cast("string") for k in keys]))
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    checked = right.filter(known).withColumn("_times", times)
    return checked.filter(F.when(F.col("_times") > 1, repeated.cast("boolean")).otherwise(True)).drop("_times")


def _left_columns_first(joined: DataFrame, left: DataFrame) -> DataFrame:
    known = {c.lower() for c in left.columns}
    return joined.select(*left.columns, *[c for c in joined.columns if c.lower() not in known])
