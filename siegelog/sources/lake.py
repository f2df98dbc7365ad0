"""The partitioned Parquet lake: write, read, compact, statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

PARTITION = ("year", "month")


def write_attacks(
    attacks: DataFrame, path: str, mode: str = "append", rebalance: bool = False
) -> None:
    """Write the fact as snappy Parquet, partitioned by year and month.

    Rows without a date have no partition and are left out; ``undated`` counts
    them. Each task writes the partitions it meets, without a shuffle. With
    ``rebalance`` rows are first brought together by partition in files of even
    size; large partitions are split over several tasks.
    """
    dated = attacks.filter(F.col("datetime").isNotNull())
    if rebalance:
        dated = dated.hint("rebalance", *[F.col(c) for c in PARTITION])
    (
        dated.write.mode(mode)
        .option("compression", "snappy")
        .partitionBy(*PARTITION)
        .parquet(path)
    )


@dataclass(frozen=True)
class Written:
    """What ``write_checked`` wrote: the folders of kept and rejected rows, and counts taken on the way."""

    accepted: str
    rejected: str
    rows: int
    undated_rows: int
    first: object
    last: object


def write_checked(attacks: DataFrame, path: str, mode: str = "overwrite") -> Written:
    """Write the fact and its rejects in one pass: counts come with the write, not from another scan.

    ``path/accepted=true`` is the lake by year and month; rows without a date go to
    ``path/accepted=false`` as they are. Rows by partition are in the footers of the
    written files (``partition_counts`` of ``read_attacks(spark, written.accepted)``).
    """
    seen = Observation("written")
    undated_row = F.col("datetime").isNull()
    counted = attacks.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(undated_row).alias("undated_rows"),
        F.min("datetime").alias("first"),
        F.max("datetime").alias("last"),
    )
    (
        counted.withColumn("accepted", ~undated_row)
        .write.mode(mode)
        .option("compression", "snappy")
        .partitionBy("accepted", *PARTITION)
        .parquet(path)
    )
    return Written(f"{path}/accepted=true", f"{path}/accepted=false", **seen.get)


def undated(attacks: DataFrame) -> DataFrame:
    """Number of rows that ``write_attacks`` leaves out, one row."""
    return attacks.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("datetime").isNull()).alias("undated_rows"),
    )


def read_attacks(
    spark: SparkSession,
    path: str,
    start: str | None = None,
    end: str | None = None,
    merge_schema: bool = False,
) -> DataFrame:
    """The fact, or the part of it between two dates.

    A date range is applied to the partition columns as well, since a filter on
    ``datetime`` alone does not prune folders. ``merge_schema`` unions files
    with differing columns by name.
    """
    attacks = spark.read.option("mergeSchema", merge_schema).parquet(path)
    month = F.col("year") * 12 + F.col("month")
    if start is not None:
        attacks = attacks.filter(
            (month >= F.year(F.lit(start).cast("date")) * 12 + F.month(F.lit(start).cast("date")))
            & (F.col("datetime") >= F.lit(start).cast("timestamp_ntz"))
        )
    if end is not None:
        attacks = attacks.filter(
            (month <= F.year(F.lit(end).cast("date")) * 12 + F.month(F.lit(end).cast("date")))
            & (F.col("datetime") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
        )
    return attacks


def read_by_name(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files with differing columns, united by name; a column a file lacks is NULL."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def attacks_view(attacks: DataFrame, name: str = "attacks") -> None:
    attacks.createOrReplaceTempView(name)


def file_statistics(data: DataFrame) -> DataFrame:
    """One row per file: path, bytes, rows. ``data`` must be a direct file read."""
    return (
        data.select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")
        )
        .groupBy("file", "bytes")
        .agg(F.count("*").alias("rows"))
    )


def conversion_statistics(attacks: DataFrame) -> DataFrame:
    """Files, bytes and rows of every partition folder."""
    return (
        attacks.select(
            *PARTITION,
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("bytes"),
        )
        .groupBy(*PARTITION, "file", "bytes")
        .agg(F.count("*").alias("rows"))
        .groupBy(*PARTITION)
        .agg(
            F.count("*").alias("files"),
            F.sum("bytes").alias("bytes"),
            F.sum("rows").alias("rows"),
        )
    )


def partition_counts(attacks: DataFrame) -> DataFrame:
    """Rows of every partition that ``write_attacks`` would write."""
    return (
        attacks.filter(F.col("datetime").isNotNull())
        .groupBy(*PARTITION)
        .agg(F.count("*").alias("rows"))
    )


def compact(
    spark: SparkSession, path: str, staging: str, merge_schema: bool = True
) -> DataFrame:
    """Rewrite the partitions of ``path`` that hold more than one file.

    The new files are written to ``staging`` first; only when their row counts
    agree are the partitions of ``path`` replaced, so a failure at any time
    leaves a whole copy. Partitions of one file are not touched. Returns
    ``year, month, files, rows`` of the rewritten partitions, as before.
    """
    source = spark.read.option("mergeSchema", merge_schema).parquet(path)
    # One row per partition folder: small enough to steer the job from here.
    todo = [
        row for row in conversion_statistics(source).select(*PARTITION, "files", "rows").collect()
        if row["files"] > 1
    ]
    report = spark.createDataFrame(
        [(r["year"], r["month"], r["files"], r["rows"]) for r in todo],
        "year int, month int, files long, rows long",
    )
    if not todo:
        return report

    def wanted(df: DataFrame) -> DataFrame:
        return df.filter(
            (F.col("year") * 12 + F.col("month")).isin([r["year"] * 12 + r["month"] for r in todo])
        )

    def store(df: DataFrame, target: str) -> None:
        (
            df.hint("rebalance", *[F.col(c) for c in PARTITION])
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "snappy")
            .partitionBy(*PARTITION)
            .parquet(target)
        )

    store(wanted(source), staging)
    staged = spark.read.parquet(staging)
    before = {(r["year"], r["month"]): r["rows"] for r in todo}
    after = {
        (r["year"], r["month"]): r["rows"]
        for r in staged.groupBy(*PARTITION).agg(F.count("*").alias("rows")).collect()
    }
    if before != after:
        raise RuntimeError("compaction lost or gained rows; the source was left as it is")
    store(staged, path)
    return report


def describe(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types, from the schema alone."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def has_column(df: DataFrame, name: str) -> bool:
    return name.lower() in {c.lower() for c in df.columns}
