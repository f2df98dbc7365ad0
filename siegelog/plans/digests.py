"""Reconciliation by content: which rows of two tables differ, told by digests.

A digest of a set of rows is their number and two sums of row hashes, so it does not
depend on their order and adds up: those of leaves (a day and a range of entities) are
stored, those of days and of the table are sums of them. Two tables are compared from
the top down, and only the rows of leaves whose digests differ are read and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ranges of entities of a day.
LEAVES = 64

DIGEST = ("rows", "sum_a", "sum_b")


def leaf_of(keys: list[str]) -> Column:
    """The range of a row's entity, by the hash of all key columns but the date."""
    return F.pmod(F.xxhash64(*[k for k in keys if k != "date"]), F.lit(LEAVES)).cast("int")


def _hashes(columns: list[str]) -> list[Column]:
    """Two independent hashes of a row in which NULL and every value count, as numbers that add up."""
    texts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    digest = F.md5(F.to_json(F.array(*texts)))
    half = lambda start: F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")
    return [half(1), half(17)]


def leaf_digests(table: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """``date, leaf`` and the digest of each leaf: one pass, summed before the shuffle."""
    a, b = _hashes([*keys, *measures])
    return table.groupBy("date", leaf_of(keys).alias("leaf")).agg(
        F.count("*").alias("rows"), F.sum(a).alias("sum_a"), F.sum(b).alias("sum_b")
    )


def added(digests: DataFrame, *by: str) -> DataFrame:
    """Digests of larger parts: of days (``date``) or, without columns, of the whole table."""
    return digests.groupBy(*by).agg(*[F.sum(c).alias(c) for c in DIGEST])


def differing(first: DataFrame, second: DataFrame, *by: str) -> DataFrame:
    """Parts whose digests differ, or that one side lacks."""
    a = first.select(*[F.col(c).alias(f"a_{c}") for c in (*by, *DIGEST)])
    b = second.select(*[F.col(c).alias(f"b_{c}") for c in (*by, *DIGEST)])
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    unequal = F.lit(False)
    for c in DIGEST:
        unequal = unequal | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    # a side's columns are all NULL where it lacks the part; a part always has rows
    joined = a.join(b, same, "full").filter(unequal)
    present = F.col("a_rows").isNotNull()
    return joined.select(*[F.when(present, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in by])


def differing_leaves(first: DataFrame, second: DataFrame) -> DataFrame:
    """``date, leaf`` that differ: days first, then the leaves of those days alone."""
    days = differing(added(first, "date"), added(second, "date"), "date").withColumnRenamed("date", "day")

    def within(digests: DataFrame) -> DataFrame:
        return digests.join(days, F.col("date").eqNullSafe(F.col("day")), "left_semi")

    return differing(within(first), within(second), "date", "leaf")


def differing_rows(
    first: DataFrame,
    second: DataFrame,
    keys: list[str],
    measures: list[str],
    first_digests: DataFrame | None = None,
    second_digests: DataFrame | None = None,
) -> DataFrame:
    """Rows that are not in both tables: the columns and ``side``, ``only_first`` or ``only_second``; repeats count.

    A changed row appears twice, as each side has it. With digests stored earlier only
    rows of differing leaves are read with their measures; ``date`` is one of the keys.
    """
    a = first_digests if first_digests is not None else leaf_digests(first, keys, measures)
    b = second_digests if second_digests is not None else leaf_digests(second, keys, measures)
    wanted = differing_leaves(a, b).toDF("day", "at")
    columns = [*keys, *measures]

    def suspects(table: DataFrame) -> DataFrame:
        same = F.col("date").eqNullSafe(F.col("day")) & (leaf_of(keys) == F.col("at"))
        return table.select(*columns).join(wanted, same, "left_semi")

    left, right = suspects(first), suspects(second)
    # +1 for every copy on one side, -1 on the other: what is left over is in one only
    marked = left.withColumn("copies", F.lit(1)).unionByName(right.withColumn("copies", F.lit(-1)))
    counts = marked.groupBy(*columns).agg(F.sum("copies").alias("copies")).filter("copies <> 0")
    return (
        counts.withColumn("side", F.when(F.col("copies") > 0, "only_first").otherwise("only_second"))
        .withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("copies"))))
        .drop("copies")
    )
