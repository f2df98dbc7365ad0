"""Search, sort, page and average rank over one row per entity."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siegelog.functions.scale import broadcast_if_bounded, reliable_checkpoint, stored_copy
from siegelog.operators.joins import skewed_join
from siegelog.schema import ENTITY

# Metrics where less is better; all others rank the greatest first.
ASCENDING = ("first_seen", *ENTITY.values())

# A slice that ends within this many rows is taken from the head of the sort, by
# one task; a deeper one is cut from distributed positions.
HEAD_ROWS = 100_000

# Values of a metric that cut it into ranges.
CUTS = 256

# Columns of one value of one metric, in rank order.
VALUE = ("metric", "missing", "number", "name")

# Low bits of ``monotonically_increasing_id`` that number the rows of a partition.
ROW_BITS = 33


def search(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows whose ``key`` contains ``text``, in any case; all rows for no text."""
    return df.filter(F.lower(key).contains(text.lower())) if text else df


def _sort_value(df: DataFrame, metric: str) -> Column:
    names = metric in ENTITY.values() and isinstance(df.schema[metric].dataType, T.StringType)
    return F.lower(metric) if names else F.col(metric)


def sort_by(df: DataFrame, metric: str, desc: bool = True, key: str | None = None) -> DataFrame:
    """Sort by one metric, NULLs last either way; ties by ``key``."""
    value = _sort_value(df, metric)
    order = value.desc_nulls_last() if desc else value.asc_nulls_last()
    return df.orderBy(order, *([F.asc(key)] if key else []))


def rows_from(df: DataFrame, order: list[Column], offset: int, n: int | None) -> DataFrame:
    """``n`` rows (None: all) of a total order, after the first ``offset``."""
    if n is not None and offset + n <= HEAD_ROWS:
        rows = df.orderBy(*order)
        return (rows.offset(offset) if offset else rows).limit(n)
    if n is None and not offset:
        return df
    place = F.col("position")
    wanted = place > offset if n is None else place.between(offset + 1, offset + n)
    return with_position(df, order).filter(wanted).drop("position")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows, with ``position`` in the whole list.

    ``order`` must be a total order.
    """
    skipped = (number - 1) * size
    if skipped + size > HEAD_ROWS:
        return with_position(df, order).filter(F.col("position").between(skipped + 1, skipped + size))
    # At most ``HEAD_ROWS`` rows reach this window.
    place = F.row_number().over(Window.orderBy(*order)).cast("bigint")
    return rows_from(df, order, skipped, size).withColumn("position", place + F.lit(skipped))


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(
        F.count("*").alias("rows"), F.ceil(F.count("*") / F.lit(size)).cast("bigint").alias("pages")
    )


def _numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` sorted over all partitions, with ``_part`` and ``_row`` of every row.

    The sorted rows are checkpointed, so that the numbers stay the same however
    often, and after whatever loss of executors, they are read.
    """
    placed = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    return reliable_checkpoint(placed).select(
        *df.columns,
        F.shiftright("_id", ROW_BITS).alias("_part"),
        F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_row"),
    )


def _before_partition(rows: DataFrame, weight: Column) -> DataFrame:
    """Sum of ``weight`` over all earlier partitions; one row per partition."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.groupBy("_part")
        .agg(F.sum(weight).alias("_weight"))
        .select(
            "_part",
            F.coalesce(F.sum("_weight").over(earlier), F.lit(0).cast("bigint")).alias("_before"),
        )
    )


def _partitions(df: DataFrame) -> int:
    """Bound of the partition count of a sorted frame."""
    conf = df.sparkSession.conf
    shuffled = conf.get("spark.sql.shuffle.partitions")
    return max(
        int(shuffled),
        int(conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", shuffled)),
    )


def with_position(df: DataFrame, order: list[Column]) -> DataFrame:
    """``position`` (from 1) of every row in a total order, without one big task."""
    rows = _numbered(df, order)
    offsets = _before_partition(rows, F.lit(1).cast("bigint"))
    return (
        rows.join(broadcast_if_bounded(offsets, _partitions(df)), "_part")
        .withColumn("position", F.col("_before") + F.col("_row") + 1)
        .select(*df.columns, "position")
    )


def ranks(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """``key, metric, rank``: competition rank (1, 2, 2, 4) within each metric.

    Rows are counted per distinct value. ``CUTS`` values of a metric, those with
    the least hash, cut its values into ranges; the rank of a value is 1 + rows
    in earlier ranges + rows before it in its own, so a window holds one range.
    Frequent values are left to Spark's skew join.
    """
    long = _long(df, key, metrics)
    counted = long.groupBy(*VALUE).agg(F.count("*").alias("rows"))
    value = F.struct(*VALUE[1:])
    picked = Window.partitionBy("metric").orderBy(F.xxhash64(*VALUE[1:]), *VALUE[1:])
    cuts = (
        counted.withColumn("pick", F.row_number().over(picked))
        .filter(F.col("pick") <= CUTS)
        .groupBy("metric")
        .agg(F.sort_array(F.collect_list(value)).alias("cuts"))
    )
    ranged = (
        counted.join(broadcast_if_bounded(cuts, len(metrics)), "metric")
        .withColumn("range", _below("cuts", value))
        .drop("cuts")
    )
    none = F.lit(0).cast("bigint")
    earlier = Window.partitionBy("metric").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("metric", "range")
        .agg(F.sum("rows").alias("size"))
        .select("metric", "range", F.coalesce(F.sum("size").over(earlier), none).alias("start"))
    )
    inside = (
        Window.partitionBy("metric", "range")
        .orderBy(*VALUE[1:])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ahead = F.col("start") + F.coalesce(F.sum("rows").over(inside), none)
    bounded = broadcast_if_bounded(starts, len(metrics) * (CUTS + 1))
    ranked = ranged.join(bounded, ["metric", "range"]).select(*VALUE, (ahead + 1).alias("rank"))
    return skewed_join(long, ranked, *VALUE).select(key, "metric", "rank")


def _below(cuts: str, value: Column) -> Column:
    """How many of the sorted cuts (``CUTS`` at most) are less than a value, by binary search."""
    steps = [1 << k for k in range(CUTS.bit_length() - 1, -1, -1)]
    size = F.size(cuts)

    def further(found: Column, step: Column) -> Column:
        at = found + step
        return F.when((at <= size) & (F.get(cuts, F.least(at, size) - 1) < value), at).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)


def _long(df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """One row per entity and metric, its value signed so that less is better.

    No part of a value is NULL: ``missing`` sorts last and equals itself.
    """

    def entry(metric: str) -> Column:
        text = isinstance(df.schema[metric].dataType, T.StringType)
        number, name = F.lit(None).cast("double"), F.lit(None).cast("string")
        if text and metric in ENTITY.values():
            name = F.lower(metric)
        elif text or isinstance(df.schema[metric].dataType, T.DateType):
            number = F.unix_date(F.col(metric).cast("date")).cast("double")
        else:
            number = F.col(metric).cast("double")
        sign = F.lit(1.0 if metric in ASCENDING else -1.0)
        return F.struct(
            F.lit(metric).alias("metric"),
            F.col(metric).isNull().alias("missing"),
            F.coalesce(sign * number, F.lit(0.0)).alias("number"),
            F.coalesce(name, F.lit("")).alias("name"),
        )

    return df.select(key, F.inline(F.array(*[entry(m) for m in metrics])))


def average_rank(
    df: DataFrame, metrics: list[str], key: str, total: str = "total_attacks", best_first: bool = True
) -> DataFrame:
    """``df`` with ``rank_<metric>`` of every metric and their mean ``avg_rank``.

    Sorted by the mean; equal means by ``total`` descending, then by name. The
    input is evaluated once and stored, as the ranks read it several times.
    """
    df = stored_copy(df, "ranked")
    by_key = (
        ranks(df, key, metrics)
        .groupBy(key)
        .agg(
            *[
                F.max(F.when(F.col("metric") == m, F.col("rank"))).alias(f"rank_{m}")
                for m in metrics
            ]
        )
    )
    mean = reduce(add, [F.col(f"rank_{m}") for m in metrics]).cast("double") / F.lit(
        float(len(metrics))
    )
    order = F.asc("avg_rank") if best_first else F.desc("avg_rank")
    return (
        df.join(by_key, key)
        .withColumn("avg_rank", mean)
        .orderBy(order, F.desc(total), F.asc(key))
    )


def rank_breakdown(ranked: DataFrame, key: str, n: int = 50, total: str = "total_attacks") -> DataFrame:
    """The best ``n`` entities with their final place and the rank in each metric."""
    order = [F.asc("avg_rank"), F.desc(total), F.asc(key)]
    best = ranked.orderBy(*order).limit(n)
    # At most ``n`` rows reach this window.
    place = F.row_number().over(Window.orderBy(*order)).cast("bigint")
    columns = [c for c in ranked.columns if c.startswith("rank_")]
    return best.withColumn("final_rank", place).select("final_rank", key, *columns, "avg_rank")
