"""An attack log made of the given tables.

``events`` is the log, ``supplier`` with ``nation`` and ``region`` the address
lookup. There are fewer suppliers than users in ``events``, so a third of the
addresses are missing from the lookup; many addresses have days without rows.
"""

from __future__ import annotations

import datetime as dt
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demo.settings import DAY, IP
from siegelog.functions.scale import scratch_path
from siegelog.operators.bitmaps import EntitySets
from siegelog.operators.heavy import DailySketches
from siegelog.operators.name_index import NameIndex
from siegelog.operators.rollups import Rollups, base_from_log
from siegelog.operators.sketch_sets import SketchStore
from siegelog.operators.spans import DayBlocks
from siegelog.operators.threshold import SizeClasses
from siegelog.plans.blocks import build_blocks, entity_days
from siegelog.schema import ENTITY
from siegelog.sources import lake
from siegelog.sources.logs import enrich, normalise


# The functions below are cached per session and folder: a plan is made once, as
# a view would be. No data is cached.


@lru_cache(maxsize=None)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _address(number: Column) -> Column:
    return F.concat(
        F.lit("10.0."),
        F.floor(number / 256).cast("string"),
        F.lit("."),
        (number % 256).cast("string"),
    )


@lru_cache(maxsize=None)
def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, user = F.col("ts"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return (
        table(spark, sf_dir, "events")
        .select(
            ts.alias("datetime"),
            F.year(ts).alias("year"),
            F.month(ts).alias("month"),
            _address(user).alias("ip"),
            (F.hour(ts) * 10000 + F.minute(ts) * 100).cast("bigint").alias("time"),
            F.concat(F.lit("node_"), (user % 3).cast("string")).alias("node"),
            F.when(k < 60, 22).otherwise(2222).cast("bigint").alias("port"),
            F.col("event_id").cast("string").alias("pid"),
            F.concat("event_type", F.lit("_"), (k % 8).cast("string")).alias("username"),
            F.col("event_type").alias("tag"),
        )
    )


@lru_cache(maxsize=None)
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation = F.col("s_suppkey"), F.col("n_nationkey")
    network = (key % 7).cast("string")
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == nation)
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            _address(key).alias("ip"),
            F.col("r_name").alias("continent"),
            F.concat(F.lit("C"), nation.cast("string")).alias("country_code"),
            F.col("n_name").alias("country"),
            (nation * 5 - 60).cast("double").alias("latitude"),
            (nation * 10 - 120).cast("double").alias("longitude"),
            F.concat(F.lit("AS"), network).alias("asn"),
            F.concat(F.lit("NET_"), network).alias("asn_name"),
            F.concat(F.lit("net"), network, F.lit(".example")).alias("asn_domain"),
            F.when(key % 3 == 0, "isp")
            .when(key % 3 == 1, "hosting")
            .otherwise("business")
            .alias("asn_type"),
        )
    )


@lru_cache(maxsize=None)
def lookup_bound(spark: SparkSession, sf_dir: str) -> int:
    """The lookup has at most one row per supplier; counted from file footers."""
    return table(spark, sf_dir, "supplier").count()


@lru_cache(maxsize=None)
def attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # s_suppkey is the key of its table
    return enrich(raw_log(spark, sf_dir), lookup(spark, sf_dir), lookup_bound(spark, sf_dir), unique=True)


@lru_cache(maxsize=None)
def rollups(spark: SparkSession, sf_dir: str) -> Rollups:
    log, known = raw_log(spark, sf_dir), lookup(spark, sf_dir)
    return Rollups.of_base(base_from_log(log, known, lookup_bound(spark, sf_dir), unique=True))


@lru_cache(maxsize=None)
def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole events table as a raw text log, with defects of real logs in it."""
    ts, number = F.col("ts"), F.col("event_id")
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        F.when(number % 17 == 0, "20241301")
        .when(number % 19 == 0, "abc")
        .otherwise(F.date_format(ts, "yyyyMMdd"))
        .alias("Date"),
        F.when(number % 5 == 0, None)
        .otherwise(F.concat(F.hour(ts).cast("string"), F.lit(".5")))
        .alias("Time"),
        _address(F.col("user_id")).alias("IP"),
        F.concat(F.lit("node_"), (F.col("user_id") % 3).cast("string")).alias("Node"),
        F.when(number % 7 == 0, "abc").when(number % 11 == 0, "22.7").otherwise(k).alias("Port"),
        number.cast("string").alias("PID"),
        F.when(number % 13 == 0, "")
        .when(number % 23 == 0, "NA")
        .when(number % 29 == 0, None)
        .otherwise(F.col("event_type"))
        .alias("Username"),
        F.col("event_type").alias("Tag"),
        F.col("props").alias("Message"),
    )


def _supplier_address(key: Column) -> Column:
    return F.concat(F.lit("10.1."), F.floor(key / 256).cast("string"), F.lit("."), (key % 256).cast("string"))


def given(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Files of given tables with differing columns, united by name."""
    return lake.read_by_name(spark, *(f"{sf_dir}/{name}.parquet" for name in names))


@lru_cache(maxsize=None)
def wide_rollups(spark: SparkSession, sf_dir: str) -> Rollups:
    """A log of many years: ``lineitem`` by ship date, ``supplier`` as its lookup."""
    lines = table(spark, sf_dir, "lineitem")
    log = lines.select(
        F.col("l_shipdate").alias("datetime"),
        _supplier_address(F.col("l_suppkey")).alias("ip"),
        F.concat("l_returnflag", "l_linestatus").alias("username"),
    )
    key = F.col("s_suppkey")
    network = (key % 7).cast("string")
    suppliers = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            _supplier_address(key).alias("ip"),
            F.col("n_name").alias("country"),
            F.concat(F.lit("AS"), network).alias("asn"),
            F.concat(F.lit("NET_"), network).alias("asn_name"),
        )
    )
    # lines are counted from file footers
    return Rollups.of_log(log, suppliers, lines.count(), lookup_bound(spark, sf_dir), unique=True)


# Tables that are stored once, in the folder the cluster shares, and read by several queries.


@lru_cache(maxsize=None)
def entity_sets(spark: SparkSession, sf_dir: str, dim: str, *groups: str) -> EntitySets:
    """Daily bitmaps of the entities of a dimension."""
    sets = EntitySets(scratch_path(spark, f"sets-{dim}"), ENTITY[dim], groups)
    return sets.build(getattr(rollups(spark, sf_dir), dim))


@lru_cache(maxsize=None)
def name_index(spark: SparkSession, sf_dir: str, dim: str) -> NameIndex:
    index = NameIndex(scratch_path(spark, f"names-{dim}"), ENTITY[dim])
    return index.build(getattr(rollups(spark, sf_dir), dim))


@lru_cache(maxsize=None)
def blocks(spark: SparkSession, sf_dir: str, dim: str) -> DayBlocks:
    return build_blocks(rollups(spark, sf_dir), dim, scratch_path(spark, f"blocks-{dim}"), days=64)


@lru_cache(maxsize=None)
def wide_blocks(spark: SparkSession, sf_dir: str, dim: str) -> DayBlocks:
    return build_blocks(wide_rollups(spark, sf_dir), dim, scratch_path(spark, f"wide-{dim}"), days=2048)


# Days that arrive late: at both ends of the log and inside it.
LATE = ("2024-01-01", "2024-01-02", "2024-01-10", "2024-01-11", "2024-01-30")


@lru_cache(maxsize=None)
def refreshed_blocks(spark: SparkSession, sf_dir: str, dim: str) -> DayBlocks:
    """Blocks of a log in which the days of ``LATE`` were wrong or missing at first."""
    days = entity_days(rollups(spark, sf_dir), dim)
    late = F.col("date").isin([dt.date.fromisoformat(d) for d in LATE])
    wrong = days.filter(~late | (F.col("date") == LATE[2])).withColumn(
        "attacks", F.when(late, F.col("attacks") * 50).otherwise(F.col("attacks"))
    )
    stored = DayBlocks(scratch_path(spark, f"late-{dim}"), ENTITY[dim], 6).build(wrong)
    return stored.refresh(days, [dt.date.fromisoformat(d) for d in LATE])


@lru_cache(maxsize=None)
def log_sketches(spark: SparkSession, sf_dir: str) -> DailySketches:
    """Bucket counts of addresses and usernames by day, straight from the log."""
    rows = raw_log(spark, sf_dir).withColumn("date", F.to_date("datetime"))
    return DailySketches(scratch_path(spark, "heavy"), ("ip", "username")).build(rows)


@lru_cache(maxsize=None)
def theta_store(spark: SparkSession, sf_dir: str) -> SketchStore:
    store = SketchStore(scratch_path(spark, "theta"), "ip", ("country",))
    return store.build(rollups(spark, sf_dir).ip)


@lru_cache(maxsize=None)
def size_classes(spark: SparkSession, sf_dir: str, dim: str, wide: bool = False) -> SizeClasses:
    tables = wide_rollups(spark, sf_dir) if wide else rollups(spark, sf_dir)
    return SizeClasses(scratch_path(spark, f"classes-{dim}"), ENTITY[dim]).build(getattr(tables, dim))


@lru_cache(maxsize=None)
def drifting_files(spark: SparkSession, sf_dir: str) -> tuple[str, ...]:
    """The events of four groups of users as files with differing columns and types.

    Numbers that a narrow type does not hold are in files of their own, as BIGINT.
    """
    events, path = table(spark, sf_dir, "events"), scratch_path(spark, "drift")
    user, number = F.col("user_id"), F.col("event_id")
    fits = {"int": number.between(-(2**31), 2**31 - 1), "short": user.between(-(2**15), 2**15 - 1)}
    half = (number + F.lit(0.5)).alias("event_id")
    first, second = events.filter(user % 4 == 0), events.filter(user % 4 == 1)
    day, moment = F.to_date("ts").alias("ts"), F.col("ts").cast("timestamp_ntz").alias("ts")
    parts = [
        first.filter(fits["int"] | number.isNull()).select(number.cast("int").alias("event_id"), user.alias("user_id"), day),
        first.filter(~fits["int"]).select(number.alias("event_id"), user.alias("user_id"), day),
        second.filter(fits["short"]).select(half, user.cast("short").alias("USER_ID"), moment),
        second.filter(~fits["short"]).select(half, user.alias("USER_ID"), moment),
        events.filter(user % 4 == 2).select(number.alias("event_id"), F.concat(F.lit("u"), user.cast("string")).alias("user_id"), day, "event_type"),
        events.filter(user % 4 == 3).select(number.alias("event_id"), user.cast("double").alias("user_id"), F.lit(None).cast("date").alias("ts"), (number % 2 == 0).alias("event_type")),
    ]
    for k, part in enumerate(parts):
        part.write.parquet(f"{path}/{k}")
    return tuple(f"{path}/{k}" for k in range(len(parts)))


def altered_ip_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily address rollup with a few rows changed, one dropped and one added."""
    rollup = rollups(spark, sf_dir).ip.select("date", "ip", "country", "attacks")
    changed = (F.col("ip") == IP) & F.dayofmonth("date").isin(5, 17)
    dropped = (F.col("ip") == "10.0.0.7") & (F.col("date") == F.lit(DAY).cast("date"))
    added = rollup.filter((F.col("ip") == IP) & (F.col("date") == F.lit(DAY).cast("date"))).withColumn("ip", F.lit("planted"))
    kept = rollup.filter(~dropped).withColumn("attacks", F.when(changed, F.col("attacks") + 3).otherwise(F.col("attacks")))
    return kept.unionByName(added)


# The raw files a user starts from, made of the given tables.


@lru_cache(maxsize=None)
def csv_logs(spark: SparkSession, sf_dir: str) -> str:
    """The text log as CSV files with a header, in a folder for each sensor."""
    path = scratch_path(spark, "csv")
    names = ["Date", "Time", "IP", "Node", "Port", "PID", "Username", "Tag", "Message"]
    log = raw_text(spark, sf_dir).select(*names, F.col("Node").alias("sensor"))
    log.write.partitionBy("sensor").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


@lru_cache(maxsize=None)
def json_lookups(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The lookup as JSON objects keyed by address, one for each network in a file of its own, and as lines."""
    known = lookup(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    owner = F.struct(
        F.col("asn"), F.col("asn_name").alias("name"), F.col("asn_domain").alias("domain"), F.col("asn_type").alias("type")
    ).alias("asn")
    entry = F.struct(
        F.col("continent").alias("cntn"),
        F.col("country_code").alias("cc"),
        F.col("country").alias("cn"),
        F.when(F.col("asn") == "AS3", F.lit("unknown")).otherwise(text("latitude")).alias("lat"),
        text("longitude").alias("lng"),
        owner,
    )
    objects, lines = scratch_path(spark, "lookup"), scratch_path(spark, "lookup-lines")
    each = known.select("asn_name", "ip", entry.alias("entry"))
    whole = each.groupBy("asn_name").agg(F.map_from_entries(F.collect_list(F.struct("ip", "entry"))).alias("entries"))
    whole.select(F.to_json("entries").alias("value")).write.option("maxRecordsPerFile", 1).text(objects)
    each.select(F.to_json(F.struct("ip", "entry")).alias("value")).write.text(lines)
    return objects, lines


@lru_cache(maxsize=None)
def stored_lake(spark: SparkSession, sf_dir: str) -> str:
    """The normalised log written in two appends, and compacted to fewer files."""
    path = scratch_path(spark, "lake")
    log = normalise(raw_text(spark, sf_dir))
    number = F.col("PID").cast("bigint")
    for half in (0, 1):
        lake.write_attacks(log.filter(number % 2 == half).repartition(3), path)
    lake.compact(spark, path, scratch_path(spark, "staging"))
    return path
