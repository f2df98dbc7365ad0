"""Raw CSV logs and the address lookup: read, normalise, enrich."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siegelog import schema
from siegelog.functions import expressions as X
from siegelog.operators.joins import lookup_join

TEXT_COLUMNS = ("IP", "Node", "PID", "Username", "Tag", "Message")


def read_logs(
    spark: SparkSession,
    path: str,
    recursive: bool = False,
    multi_line: bool = False,
    with_file: bool = False,
) -> DataFrame:
    """Raw log rows, every column as text.

    ``path`` holds one folder per sensor with CSV files in it (``recursive``:
    at any depth). A header that does not match the schema fails the read
    instead of shifting columns. ``multi_line`` allows line breaks inside
    quotes, at the price of files that are no longer split into several tasks.
    ``with_file`` adds the source file and the sensor (its parent folder).
    """
    reader = (
        spark.read.schema(schema.RAW_LOG)
        .option("header", True)
        .option("enforceSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
    )
    if recursive:
        log = (
            reader.option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.csv")
            .csv(path)
        )
    else:
        log = reader.csv(f"{path.rstrip('/')}/*/*.csv")
    if with_file:
        file = F.col("_metadata.file_path")
        log = log.select(
            "*", file.alias("file"), F.element_at(F.split(file, "/"), -2).alias("sensor")
        )
    return log


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """The address lookup: one row per IP.

    Each file is one JSON object keyed by IP. A JSON object cannot be split, so
    a large lookup should come as several files (``path`` may be a glob); they
    are parsed in parallel. A repeated IP keeps its last entry, by file name and
    then by position in the file.
    """
    entries = F.from_json("value", T.MapType(T.StringType(), schema.LOOKUP_ENTRY))
    rows = (
        spark.read.option("wholetext", True)
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"), entries.alias("entries"))
        .select("file", F.posexplode("entries").alias("position", "ip", "entry"))
    )
    return _last_entries(rows)


def read_lookup_lines(spark: SparkSession, path: str) -> DataFrame:
    """The address lookup with one entry a line: ``{"ip": ..., "entry": {...}}``.

    Such files are split, so one large file is parsed by many tasks. A line that cannot
    be read is left out; a repeated IP keeps its last entry, by file name and then by
    the place of the line.
    """
    line = T.StructType([T.StructField("ip", T.StringType()), T.StructField("entry", schema.LOOKUP_ENTRY)])
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        # ids grow within a file and with the position of the file's splits
        F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("position"),
        F.from_json("value", line).alias("line"),
    )
    return _last_entries(rows.select("file", "position", "line.ip", "line.entry").filter("ip is not null"))


def _last_entries(rows: DataFrame) -> DataFrame:
    """One row per IP, from ``file, position, ip, entry``."""
    rows = rows.groupBy("ip").agg(F.max_by("entry", F.struct("file", "position")).alias("entry"))
    return rows.select(
        "ip",
        F.col("entry.cntn").alias("continent"),
        F.col("entry.cc").alias("country_code"),
        F.col("entry.cn").alias("country"),
        X.safe_double("entry.lat").alias("latitude"),
        X.safe_double("entry.lng").alias("longitude"),
        F.col("entry.asn.asn").alias("asn"),
        F.col("entry.asn.name").alias("asn_name"),
        F.col("entry.asn.domain").alias("asn_domain"),
        F.col("entry.asn.type").alias("asn_type"),
    )


def normalise(log: DataFrame, missing_text: str | None = "nan") -> DataFrame:
    """Cast the raw text columns.

    A date that is not ``yyyyMMdd`` gives a NULL ``datetime``; a bad ``Time`` or
    ``Port`` gives 0; missing text becomes ``missing_text`` (None keeps NULL).
    """
    day = F.try_to_date(F.trim("Date"), "yyyyMMdd")
    texts = {name: X.text_or(name, missing_text) for name in TEXT_COLUMNS}
    return log.withColumns(
        {
            "datetime": day.cast("timestamp_ntz"),
            "year": F.year(day),
            "month": F.month(day),
            "Time": X.whole_number_or_zero("Time"),
            "Port": X.whole_number_or_zero("Port"),
            **texts,
        }
    ).drop("Date")


def enrich(
    log: DataFrame, lookup: DataFrame, lookup_rows: int | None = None, unique: bool = False
) -> DataFrame:
    """Left join of the lookup on the address; unknown addresses get NULLs.

    ``lookup`` has one row per ``ip``; the job fails if it has not, unless the caller
    vouches for it (``unique``, as for ``read_lookup``). ``lookup_rows``, an upper bound of
    its row count, saves the check of its size (see ``lookup_join``).
    """
    return lookup_join(log, lookup, "ip", right_rows=lookup_rows, unique=unique)


def to_attacks(enriched: DataFrame) -> DataFrame:
    """The twenty columns of the enriched fact, in their fixed order."""
    return enriched.select(*[F.col(f.name).alias(f.name) for f in schema.ATTACKS.fields])
