"""Coverage, reconciliation, profiles and breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siegelog.functions import expressions as X
from siegelog.operators.rollups import Rollups
from siegelog.operators.topn import largest_per_group
from siegelog.schema import ENTITY

# Texts that stand for a missing label.
NO_LABEL = ("None", "Unknown")

# Names of the quality counts.
QUALITY_METRICS = {
    "all": "Total Records",
    "country": "Missing Country Info",
    "asn": "Missing ASN Info",
}

# Limits of a reconciliation verdict.
EXACT_ROWS = 1000
CLOSE_PERCENT = 1.0

# Fixed value: share of rows with a country that an enriched file should reach.
ENOUGH_PERCENT = 90.0


def coverage(df: DataFrame, columns: list[str], by: list[Column | str] = ()) -> DataFrame:
    """Rows, non-NULL rows and their percentage for each column, per group of ``by``."""
    names = [c if isinstance(c, str) else f"group_{i}" for i, c in enumerate(by)]
    groups = [F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for c, n in zip(by, names)]
    counts = df.groupBy(*groups).agg(
        F.count("*").alias("rows"), *[F.count(c).alias(c) for c in columns]
    )
    return counts.select(
        *names,
        "rows",
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in columns]
            )
        ),
    ).select(
        *names,
        "column",
        "rows",
        "filled",
        X.round_half_up(X.percent("filled", "rows"), 1).alias("filled_pct"),
        (X.percent("filled", "rows") > ENOUGH_PERCENT).cast("int").alias("enough"),
    )


def coverage_by_file(attacks: DataFrame, columns: list[str]) -> DataFrame:
    """Coverage of every file of a direct file read."""
    rows = attacks.select(*columns, F.col("_metadata.file_path").alias("file"))
    return coverage(rows, columns, ["file"])


def quality_counts(attacks: DataFrame) -> DataFrame:
    """``metric, count`` of all rows and of rows without a country or a network."""
    counts = attacks.agg(
        F.count("*").alias("all"),
        F.count_if(X.absent("country", *NO_LABEL)).alias("country"),
        F.count_if(X.absent("asn", *NO_LABEL)).alias("asn"),
    )
    entries = [
        F.struct(F.lit(metric).alias("metric"), F.col(c).alias("count"))
        for c, metric in QUALITY_METRICS.items()
    ]
    return counts.select(F.inline(F.array(*entries)))


def port_values(attacks: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent ports, to look over the port column."""
    return (
        attacks.groupBy("port")
        .agg(F.count("*").alias("attacks"))
        .orderBy(F.desc("attacks"), F.asc("port"))
        .limit(n)
    )


def reconcile(rollup: DataFrame, stats: DataFrame, name: str = "rollup") -> DataFrame:
    """Total of a rollup against the daily statistics, one row."""
    both = (
        rollup.agg(F.sum("attacks").alias("actual"))
        .select("actual", F.lit(None).cast("bigint").alias("expected"))
        .unionByName(
            stats.agg(F.sum("total_attacks").alias("expected")).select(
                F.lit(None).cast("bigint").alias("actual"), "expected"
            )
        )
        .agg(
            F.coalesce(F.max("expected"), F.lit(0).cast("bigint")).alias("expected"),
            F.coalesce(F.max("actual"), F.lit(0).cast("bigint")).alias("actual"),
        )
    )
    difference = F.abs(F.col("expected") - F.col("actual"))
    share = X.percent(difference, "expected")
    return both.select(
        F.lit(name).alias("rollup"),
        "expected",
        "actual",
        difference.alias("difference"),
        X.round_half_up(share, 2).alias("difference_pct"),
        F.when(difference < EXACT_ROWS, "match")
        .when(share < CLOSE_PERCENT, "close")
        .otherwise("different")
        .alias("verdict"),
    )


def reconcile_all(rollups: Rollups) -> DataFrame:
    tables = ("country", "asn", "username", "ip", "ip_username")
    checks = [reconcile(getattr(rollups, t), rollups.stats, f"daily_{t}") for t in tables]
    result = checks[0]
    for check in checks[1:]:
        result = result.unionByName(check)
    return result


def rollup_profile(rollup: DataFrame, entity: str) -> DataFrame:
    """Rows, attacks, distinct entities and countries of a rollup, one row."""
    return rollup.agg(
        F.count("*").alias("rows"),
        F.sum("attacks").alias("attacks"),
        F.count_distinct(entity).alias("entities"),
        F.count_distinct("country").alias("countries"),
    )


def day_sample(
    rollup: DataFrame, entity: str, date: str, by: str | None = None, text: str | None = None,
    value: str | None = None, n: int | None = None,
) -> DataFrame:
    """One day's attacks by entity, or by ``by`` for the entities that contain
    ``text`` or equal ``value``, largest first."""
    rows = rollup.filter(F.col("date") == F.lit(date).cast("date"))
    if text is not None:
        rows = rows.filter(F.col(entity).contains(text))
    if value is not None:
        rows = rows.filter(F.col(entity) == F.lit(value))
    keys = [entity] if by is None else [entity, by]
    sample = (
        rows.groupBy(*keys)
        .agg(F.sum("attacks").alias("attacks"))
        .orderBy(F.desc("attacks"), *[F.asc(k) for k in keys])
    )
    return sample if n is None else sample.limit(n)


def breakdown(table: DataFrame, dim: str, value: str) -> DataFrame:
    """Attacks of one entity by each other dimension: ``dimension, value, attacks``.

    One pass: every row is counted once per dimension, NULL labels left out.
    """
    others = [
        (d, c) for d, c in ENTITY.items() if d != dim and c in table.columns
    ] + [("date", "date")]
    entries = [
        F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("value"))
        for d, c in others
    ]
    return (
        table.filter(F.col(ENTITY[dim]) == F.lit(value))
        .select("attacks", F.inline(F.array(*entries)))
        .filter(F.col("value").isNotNull())
        .groupBy("dimension", "value")
        .agg(F.sum("attacks").alias("attacks"))
    )


def profile(log: DataFrame, columns: list[str]) -> DataFrame:
    """``column, type, rows, filled, distinct_values, least, greatest`` of each column.

    Values are compared as text and counted once per (column, value), so the
    distinct count costs no second pass.
    """
    types = dict(log.dtypes)
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in columns
    ]
    counted = (
        log.select(F.inline(F.array(*entries)))
        .groupBy("column", "value")
        .agg(F.count("*").alias("rows"))
    )
    kinds = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(types[c]))])
    totals = counted.groupBy("column").agg(
        F.sum("rows").alias("rows"),
        F.coalesce(
            F.sum(F.when(F.col("value").isNotNull(), F.col("rows"))), F.lit(0).cast("bigint")
        ).alias("filled"),
        F.count("value").alias("distinct_values"),
        F.min("value").alias("least"),
        F.max("value").alias("greatest"),
    )
    return totals.select("column", kinds[F.col("column")].alias("type"), *totals.columns[1:])


def top_values(log: DataFrame, columns: list[str], n: int = 5) -> DataFrame:
    """The ``n`` most frequent values of each column: ``column, value, rows``."""
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in columns
    ]
    counted = (
        log.select(F.inline(F.array(*entries)))
        .groupBy("column", "value")
        .agg(F.count("*").alias("attacks"))
    )
    return largest_per_group(counted, "column", "value", n).select(
        "column", "value", F.col("attacks").alias("rows"), "place"
    )
