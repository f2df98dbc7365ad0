"""Largest values of a column, exactly, without shuffling all its distinct values.

Counts of hash buckets (``BUCKETS`` rows at most, added up before the shuffle) bound the
count of every value: a value has no more than its bucket. They are stored by day and
add up over any days, so they are a sketch that merges. Candidates are the values of
the fullest buckets; they are counted exactly, and the least of the first n counts
is a floor. Every bucket that holds less than the floor is then proven to hold no
member of the top; the values of all others are counted exactly as well, in one pass
over the rows of those buckets. On skewed data those are few; on flat data the pass
counts all values, as a plain aggregation does. The result is the same either way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 16
# Buckets whose values are counted for the floor, as a multiple of n.
FIRST = 2


def bucket_of(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def bucket_counts(rows: DataFrame, column: str, weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, bucket, total``: the sketch of a column; NULL is no value."""
    own = F.count("*") if weight is None else F.sum(weight)
    known = rows.filter(F.col(column).isNotNull())
    return known.groupBy(*by, bucket_of(column).alias("bucket")).agg(own.cast("bigint").alias("total"))


def merged(sketch: DataFrame) -> DataFrame:
    """One sketch of all rows of a stored one, such as those of some days."""
    return sketch.groupBy("bucket").agg(F.sum("total").alias("total"))


@dataclass(frozen=True)
class Proof:
    """What a search read: the floor, the buckets counted, and the greatest bucket left out."""

    floor: int
    counted: int
    left_out: int


def _counted(rows: DataFrame, column: str, weight: str | None, buckets: list[int]) -> DataFrame:
    own = F.count("*") if weight is None else F.sum(weight)
    wanted = rows.filter(F.col(column).isNotNull() & bucket_of(column).isin(buckets))
    return wanted.groupBy(column).agg(own.cast("bigint").alias("attacks"))


def largest_values(
    rows: DataFrame, column: str, n: int, weight: str | None = None, sketch: DataFrame | None = None
) -> tuple[DataFrame, Proof]:
    """The ``n`` values of ``column`` with the greatest count (or sum of ``weight``, which is positive), ties by value.

    ``sketch`` is ``bucket_counts`` of the same rows, stored earlier. Two small tables reach
    the driver: bucket totals (``BUCKETS`` rows at most) and the floor.
    """
    order = [F.desc("attacks"), F.asc(column)]
    totals = merged(sketch) if sketch is not None else bucket_counts(rows, column, weight)
    full = sorted(((r["total"], r["bucket"]) for r in totals.collect()), reverse=True)
    first = [b for _, b in full[: FIRST * n]]
    counts = _counted(rows, column, weight, first).orderBy(*order).limit(n).select("attacks").collect()
    floor = counts[-1]["attacks"] if len(counts) == n else 0
    # a bucket of exactly the floor may hold a value that wins the tie by name
    open_ = [b for total, b in full if total >= floor]
    rest = [total for total, _ in full if total < floor]
    found = _counted(rows, column, weight, open_).orderBy(*order).limit(n)
    return found, Proof(floor, len(open_), max(rest, default=0))


@dataclass(frozen=True)
class DailySketches:
    """Bucket counts of some columns by day, stored by column and sorted by date; any range of days is their sum."""

    path: str
    columns: tuple[str, ...]
    weight: str | None = None

    def build(self, rows: DataFrame) -> DailySketches:
        """From rows with ``date``; all columns are counted in one pass."""
        each = F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNotNull().alias("known"), bucket_of(c).alias("bucket")) for c in self.columns])
        )
        own = F.lit(1).cast("bigint") if self.weight is None else F.col(self.weight)
        counted = rows.select("date", own.alias("own"), each.alias("c")).filter("c.known and date is not null")
        totals = counted.groupBy("date", "c.column", "c.bucket").agg(F.sum("own").alias("total"))
        (
            totals.hint("rebalance", F.col("column"))
            .sortWithinPartitions("column", "date", "bucket")
            .write.mode("overwrite")
            .partitionBy("column")
            .parquet(self.path)
        )
        return self

    def sketch(self, spark: SparkSession, column: str, start: str, end: str) -> DataFrame:
        days = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        return merged(spark.read.parquet(self.path).filter(days & (F.col("column") == column)))

    def largest(self, rows: DataFrame, column: str, start: str, end: str, n: int) -> tuple[DataFrame, Proof]:
        """The largest values of a range of days of ``rows``, proven by the stored sketch."""
        days = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        sketch = self.sketch(rows.sparkSession, column, start, end)
        return largest_values(rows.filter(days), column, n, self.weight, sketch)
