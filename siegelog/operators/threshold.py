"""Largest entities of any range of days from days stored in classes of size.

The daily rows are stored by class, the power of two below their attacks. A search reads the
greatest classes first. Once all classes down to 2^k are read, a row that was not read has
less than 2^k attacks, so an entity not seen has less than days x 2^k in all, and one
seen on some days at most that much more for each other day. When the n-th largest sum
so far is above the bound of all entities not seen, the members of the top are among
those seen; the small rest of their rows is read for these few alone.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siegelog.functions.dates import days_between, to_day

# So many entities are looked up by name in the rest of their rows; more are joined.
NAMES = 10_000


@dataclass(frozen=True)
class Read:
    """How far a search read: the lowest class read whole, the rows in it and above, the candidates, all rows of the range."""

    lowest: int
    rows: int
    candidates: int
    all_rows: int


def size_class(attacks: Column) -> Column:
    """The number of the greatest power of two that is not above ``attacks`` (1 at least)."""
    return F.length(F.bin(attacks)) - 1


@dataclass(frozen=True)
class SizeClasses:
    """``path/class=k``: the daily rows of an entity with 2^k to 2^(k+1) - 1 attacks, sorted by date and entity."""

    path: str
    entity: str

    def build(self, daily: DataFrame) -> SizeClasses:
        """From a daily rollup; one row for each entity and day is stored."""
        days = (
            daily.filter(F.col(self.entity).isNotNull() & F.col("date").isNotNull())
            .groupBy("date", self.entity)
            .agg(F.sum("attacks").alias("attacks"))
        )
        (
            days.withColumn("class", size_class(F.col("attacks")).cast("int"))
            .hint("rebalance", F.col("class"))
            .sortWithinPartitions("class", "date", self.entity)
            .write.mode("overwrite")
            .partitionBy("class")
            .parquet(self.path)
        )
        return self

    def rows(self, spark: SparkSession, start: str | dt.date, end: str | dt.date) -> DataFrame:
        schema = f"date date, {self.entity} string, attacks bigint, class int"
        days = F.col("date").between(F.lit(to_day(start)), F.lit(to_day(end)))
        return spark.read.schema(schema).parquet(self.path).filter(days)

    def largest(
        self, spark: SparkSession, start: str | dt.date, end: str | dt.date, n: int
    ) -> tuple[DataFrame, Read]:
        """The ``n`` entities with the most attacks in a range, ties by name, and what was read for it."""
        rows = self.rows(spark, start, end)
        days = days_between(to_day(start), to_day(end))
        # one row for each class, 63 at most; the counts come from file footers
        classes = sorted(((r["class"], r["count"]) for r in rows.groupBy("class").count().collect()), reverse=True)
        order = [F.desc("attacks"), F.asc(self.entity)]
        read, below, candidates = 0, None, None
        for number, size in classes:
            read += size
            floor = 1 << number  # rows that are not read have less
            seen = rows.filter(F.col("class") >= number).groupBy(self.entity).agg(
                F.sum("attacks").alias("attacks"), F.count("*").alias("seen")
            )
            head = seen.orderBy(*order).limit(n).select("attacks").collect()
            nth = head[-1]["attacks"] if len(head) == n else 0
            if number == classes[-1][0]:
                break
            if days * (floor - 1) < nth:
                most = F.col("attacks") + (F.lit(days) - F.col("seen")) * F.lit(floor - 1)
                below, candidates = number, seen.filter(most >= nth)
                break
        if candidates is None:
            totals = rows.groupBy(self.entity).agg(F.sum("attacks").alias("attacks"))
            chosen = 0
        else:
            names = candidates.select(self.entity)
            chosen = names.count()
            rest = rows.filter(F.col("class") < below)
            if chosen <= NAMES:
                rest = rest.filter(F.col(self.entity).isin([r[0] for r in names.collect()]))
            else:
                rest = rest.join(names, self.entity, "left_semi")
            both = candidates.select(self.entity, "attacks").unionByName(rest.select(self.entity, "attacks"))
            totals = both.groupBy(self.entity).agg(F.sum("attacks").alias("attacks"))
        lowest = below if below is not None else (classes[-1][0] if classes else 0)
        return totals.orderBy(*order).limit(n), Read(lowest, read, chosen, sum(s for _, s in classes))
