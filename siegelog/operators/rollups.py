"""Daily rollups and overall statistics.

Every function takes the enriched fact (or any frame with the columns it names)
and returns an unevaluated DataFrame. ``Rollups`` holds the set the plans read:
derived on the fly, or written once and read back.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siegelog.functions import expressions as X
from siegelog.functions.scale import reliable_checkpoint, tasks_for
from siegelog.operators.joins import lookup_join, one_per_key

# Finest daily grain. Every other daily rollup is an exact re-aggregation of it.
BASE_KEYS = ("date", "ip", "username", "country", "asn", "asn_name")


def _day() -> Column:
    return F.to_date("datetime").alias("date")


def _key(name: str) -> Column:
    return _day() if name == "date" else F.col(name).alias(name)


# Rows a rollup leaves out, next to the keys it groups by.
DAILY = {
    "country": (("date", "country"), lambda: X.present("country")),
    "asn": (
        ("date", "asn", "asn_name", "country"),
        lambda: X.present("asn_name", "Unknown") & X.present("country", ""),
    ),
    "username": (
        ("date", "username", "country", "asn_name"),
        lambda: X.present("country", "") & X.present("asn_name", ""),
    ),
    "ip": (("date", "ip", "country", "asn_name"), lambda: None),
    "ip_username": (("date", "ip", "username", "country", "asn_name"), lambda: None),
}


# Rollups stored by date, and their order within a date.
PARTITIONED = {
    "asn": ("asn_name",),
    "username": ("username",),
    "ip": ("ip",),
    "ip_username": ("ip", "username"),
}


def daily_rollup(attacks: DataFrame, keys: tuple[str, ...], keep: Column | None = None) -> DataFrame:
    """Count of attacks per key; ``date`` among the keys is the day of ``datetime``."""
    rows = attacks if keep is None else attacks.filter(keep)
    return rows.groupBy(*[_key(k) for k in keys]).agg(F.count("*").alias("attacks"))


def daily(attacks: DataFrame, table: str) -> DataFrame:
    """One of the rollups of ``DAILY`` straight from the fact."""
    keys, keep = DAILY[table]
    return daily_rollup(attacks, keys, keep())


def daily_from_base(base: DataFrame, table: str) -> DataFrame:
    """The same rollup from the base grain."""
    keys, keep = DAILY[table]
    kept = keep()
    rows = base if kept is None else base.filter(kept)
    return rows.groupBy(*keys).agg(F.sum("attacks").alias("attacks"))


def base_from_log(
    log: DataFrame, lookup: DataFrame, lookup_rows: int | None = None, unique: bool = False
) -> DataFrame:
    """The base grain from the raw log, counted before it is enriched.

    The lookup depends on the address alone, so joining it to the counts gives
    the same table as counting enriched rows, and a hot address reaches the
    join as a few rows per day.
    """
    counts = daily_rollup(log, ("date", "ip", "username"))
    labels = lookup.select("ip", "country", "asn", "asn_name")
    joined = lookup_join(counts, labels, "ip", right_rows=lookup_rows, unique=unique)
    return joined.select(*BASE_KEYS, "attacks")


def daily_ip_from_log(
    log: DataFrame, lookup: DataFrame, log_rows: int, lookup_rows: int | None = None, unique: bool = False
) -> DataFrame:
    """The daily address rollup from the raw log of at most ``log_rows`` rows, grouped once.

    Rows are dealt by day and address to tasks of a bounded number of rows, so a task's
    memory does not follow the size of the log, and a hot address is spread over its days.
    Counts by day and address have one row for each label of the address, so they need not
    be grouped again: equal labels come as one with the number of their copies.
    """
    rows = log.select(_day(), "ip").repartition(tasks_for(log_rows), "date", "ip")
    counts = rows.groupBy("date", "ip").agg(F.count("*").alias("counted"))
    known = lookup if unique else one_per_key(lookup, "ip")
    labels = known.groupBy("ip", "country", "asn_name").agg(F.count("*").alias("copies"))
    joined = lookup_join(counts, labels, "ip", right_rows=lookup_rows, unique=True)
    attacks = F.col("counted") * F.coalesce("copies", F.lit(1).cast("bigint"))
    return joined.select(*DAILY["ip"][0], attacks.alias("attacks"))


def daily_stats(attacks: DataFrame) -> DataFrame:
    """Attacks and exact distinct addresses, countries and usernames per day."""
    return attacks.groupBy(_day()).agg(
        F.count("*").alias("total_attacks"), *_daily_distincts()
    )


def daily_stats_from_base(base: DataFrame) -> DataFrame:
    return base.groupBy("date").agg(F.sum("attacks").alias("total_attacks"), *_daily_distincts())


def _daily_distincts() -> list[Column]:
    return [
        F.count_distinct("ip").alias("unique_ips"),
        F.count_distinct("country").alias("unique_countries"),
        F.count_distinct("username").alias("unique_usernames"),
    ]


def _seen() -> list[Column]:
    return [F.min("datetime").alias("first_seen"), F.max("datetime").alias("last_seen")]


def _merged_seen() -> list[Column]:
    return [F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")]


def country_stats(attacks: DataFrame) -> DataFrame:
    """Totals, distinct counts, labels and mean position per country.

    The log is first counted by all text columns: the least of a text is not
    hash-aggregated by Spark, so labels are chosen among few rows only.
    """
    keys = [_key(c) for c in ("country", "country_code", "continent", "ip", "username")]
    return country_stats_of(attacks.filter(X.present("country")).groupBy(*keys).agg(*_partial()))


def _partial() -> list[Column]:
    """Measures of a partial of the overall statistics."""
    return [
        F.count("*").alias("attacks"),
        *_seen(),
        *[
            how(c).alias(f"{name}_{c}")
            for c in ("latitude", "longitude")
            for name, how in (("sum", F.sum), ("count", F.count))
        ],
    ]


def country_stats_of(partials: DataFrame) -> DataFrame:
    """``country_stats`` from partial counts by at least country, its labels, address and username.

    Labels and measures are added up by hash first, so that the least label is picked
    among a country's labels and not among its addresses.
    """
    counted = partials.filter(X.present("country"))
    sums = [F.sum(f"{name}_{c}").alias(f"{name}_{c}") for c in ("latitude", "longitude") for name in ("sum", "count")]
    labels = counted.groupBy("country", "country_code", "continent").agg(
        F.sum("attacks").alias("attacks"), *_merged_seen(), *sums
    )
    distinct = counted.groupBy("country").agg(
        F.count_distinct("ip").alias("unique_ips"), F.count_distinct("username").alias("unique_usernames")
    )

    def mean(c: str) -> Column:
        count = F.sum(f"count_{c}")
        return F.when(count > 0, F.sum(f"sum_{c}") / count).alias(f"avg_{c}")

    totals = labels.groupBy("country").agg(
        F.min("country_code").alias("country_code"),
        F.min("continent").alias("continent"),
        F.sum("attacks").alias("total_attacks"),
        *_merged_seen(),
        mean("latitude"),
        mean("longitude"),
    )
    columns = ["country", "country_code", "continent", "total_attacks", "unique_ips", "unique_usernames"]
    return totals.join(distinct, "country").select(
        *columns, "first_seen", "last_seen", "avg_latitude", "avg_longitude"
    )


def top_ips(attacks: DataFrame, limit: int | None) -> DataFrame:
    """Totals per address; counted by all text columns first, as ``country_stats``."""
    keys = [_key(c) for c in ("ip", "country", "asn", "asn_name", "username")]
    return top_ips_of(attacks.groupBy(*keys).agg(F.count("*").alias("attacks"), *_seen()), limit)


def top_ips_of(partials: DataFrame, limit: int | None) -> DataFrame:
    """``top_ips`` from partial counts by at least address, its labels and username.

    Counts are added up by labels first, by hash; then the least label is picked among
    an address's few.
    """

    def label(name: str) -> Column:
        return F.min(F.coalesce(F.col(name), F.lit("Unknown"))).alias(name)

    named = partials.groupBy("ip", "country", "asn", "asn_name").agg(F.sum("attacks").alias("attacks"), *_merged_seen())
    totals = named.groupBy("ip").agg(
        label("country"), label("asn"), label("asn_name"), F.sum("attacks").alias("attack_count"), *_merged_seen()
    )
    distinct = partials.groupBy(F.col("ip").alias("of")).agg(F.count_distinct("username").alias("unique_usernames"))
    joined = _largest(totals, "attack_count", "ip", limit).join(distinct, F.col("ip").eqNullSafe(F.col("of")))
    return _largest(joined, "attack_count", "ip", limit).select(
        "ip", "country", "asn", "asn_name", "attack_count", "unique_usernames", "first_seen", "last_seen"
    )


def username_stats(attacks: DataFrame, limit: int | None) -> DataFrame:
    keys = [_key(c) for c in ("username", "ip", "country")]
    return username_stats_of(attacks.groupBy(*keys).agg(F.count("*").alias("attacks"), *_seen()), limit)


def username_stats_of(partials: DataFrame, limit: int | None) -> DataFrame:
    """``username_stats`` from partial counts by at least username, address and country."""
    totals = partials.groupBy("username").agg(
        F.sum("attacks").alias("attempt_count"),
        F.count_distinct("ip").alias("unique_ips"),
        F.count_distinct("country").alias("unique_countries"),
        *_merged_seen(),
    )
    return _largest(totals, "attempt_count", "username", limit)


def hourly_patterns(attacks: DataFrame) -> DataFrame:
    hour = F.hour("datetime").cast("bigint").alias("hour")
    return hourly_patterns_of(attacks.groupBy(hour, "ip").agg(F.count("*").alias("attacks")))


def hourly_patterns_of(partials: DataFrame) -> DataFrame:
    """``hourly_patterns`` from partial counts by at least hour and address."""
    return partials.groupBy("hour").agg(
        F.sum("attacks").alias("attack_count"), F.count_distinct("ip").alias("unique_ips")
    )


# Keys of the two kinds of partials that one pass over the fact gives.
OVERALL_KEYS = ("hour", "ip", "username", "country", "asn", "asn_name", "country_code", "continent")


def fact_partials(attacks: DataFrame) -> DataFrame:
    """The base grain (``kind`` 'daily') and the partials of the overall statistics ('overall') in one pass."""
    rows = attacks.select(
        _day(), F.hour("datetime").cast("bigint").alias("hour"), *OVERALL_KEYS[1:], "datetime", "latitude", "longitude"
    )
    every = ["date", *OVERALL_KEYS]
    grouped = rows.groupingSets([list(BASE_KEYS), list(OVERALL_KEYS)], *every)
    kind = F.when(F.grouping("hour") == 1, "daily").otherwise("overall")
    return grouped.agg(kind.alias("kind"), *_partial())


def _largest(df: DataFrame, metric: str, key: str, limit: int | None) -> DataFrame:
    return df if limit is None else df.orderBy(F.desc(metric), F.asc(key)).limit(limit)


# Text columns whose distinct values a sketch counts.
SKETCHED = {"ips": "ip", "countries": "country", "usernames": "username"}


def daily_sketches(attacks: DataFrame) -> DataFrame:
    """Daily statistics that can be merged: distinct counts as HyperLogLog sketches."""
    return attacks.groupBy(_day()).agg(
        F.count("*").alias("total_attacks"),
        *[F.hll_sketch_agg(c).alias(f"sketch_{name}") for name, c in SKETCHED.items()],
    )


def estimates(sketches: DataFrame) -> DataFrame:
    """``daily_stats`` from sketches; the distinct counts are approximate."""
    return sketches.select(
        "date",
        "total_attacks",
        *[F.hll_sketch_estimate(f"sketch_{name}").alias(f"unique_{name}") for name in SKETCHED],
    )


def merge_rollups(*parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Add up partial rollups, such as one per file or per day of arrival.

    Columns beside the keys are merged by name: ``first_seen`` takes the least,
    ``last_seen`` the greatest, sketches are united, counts are summed. Plain
    distinct counts cannot be merged and are refused.
    """
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    measures = [c for c in merged.columns if c not in keys]
    inexact = [c for c in measures if c.startswith(("unique_", "avg_"))]
    if inexact:
        raise ValueError(f"cannot merge {inexact}: rebuild them from the base rollup")
    how = {"first_seen": F.min, "last_seen": F.max}
    how.update({f"sketch_{name}": F.hll_union_agg for name in SKETCHED})
    return merged.groupBy(*keys).agg(*[how.get(c, F.sum)(c).alias(c) for c in measures])


def rollup_duplicates(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Per day: rows before and after merging repeated keys, and how many go."""
    return (
        parts.groupBy(*keys)
        .agg(F.count("*").alias("copies"))
        .groupBy("date")
        .agg(F.sum("copies").alias("rows_before"), F.count("*").alias("rows_after"))
        .withColumn("duplicates_removed", F.col("rows_before") - F.col("rows_after"))
    )


def date_range(stats: DataFrame) -> DataFrame:
    return stats.agg(
        X.day_text(F.min("date")).alias("min_date"), X.day_text(F.max("date")).alias("max_date")
    )


@dataclass(frozen=True)
class Rollups:
    """The daily tables the plans read."""

    stats: DataFrame
    country: DataFrame
    asn: DataFrame
    username: DataFrame
    ip: DataFrame
    ip_username: DataFrame

    @classmethod
    def of(cls, attacks: DataFrame) -> Rollups:
        """Derived from the fact on every use; each plan evaluates only what it reads."""
        return cls(stats=daily_stats(attacks), **{t: daily(attacks, t) for t in DAILY})

    @classmethod
    def of_base(cls, base: DataFrame) -> Rollups:
        """As ``of``, from the base grain: with ``base_from_log`` the log is counted before it is enriched."""
        return cls(stats=daily_stats_from_base(base), **{t: daily_from_base(base, t) for t in DAILY})

    @classmethod
    def of_log(
        cls, log: DataFrame, lookup: DataFrame, log_rows: int, lookup_rows: int | None = None, unique: bool = False
    ) -> Rollups:
        """As ``of_base``, from the raw log of at most ``log_rows`` rows; the address rollup without usernames in between."""
        tables = cls.of_base(base_from_log(log, lookup, lookup_rows, unique))
        return replace(tables, ip=daily_ip_from_log(log, lookup, log_rows, lookup_rows, unique))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Rollups:
        return cls(**{f.name: spark.read.parquet(f"{path}/daily_{f.name}") for f in fields(cls)})

    @classmethod
    def build(cls, attacks: DataFrame, path: str) -> Rollups:
        """Write all rollups under ``path`` and return them as stored.

        The fact is scanned once, for the base grain; the others come from the
        stored base. The tables with many entities per day are partitioned by
        date and sorted by entity, so date filters skip folders and entity
        filters skip row groups.
        """
        return cls.build_from_base(daily_rollup(attacks, BASE_KEYS), path)

    @classmethod
    def build_from_base(cls, base: DataFrame, path: str) -> Rollups:
        """As ``build``, from the base grain (see ``base_from_log``)."""
        spark, by_day = base.sparkSession, ("date",)
        base_path = f"{path}/daily_base"
        _store(base, base_path, by_day, ("ip", "username"))
        base = spark.read.parquet(base_path)
        tables = [("stats", daily_stats_from_base(base), (), ("date",))]
        tables.append(("country", daily_from_base(base, "country"), (), ("date", "country")))
        for table, order in PARTITIONED.items():
            tables.append((table, daily_from_base(base, table), by_day, order))
        # The writes do not depend on each other; together they fill the cluster.
        with ThreadPoolExecutor(len(tables)) as pool:
            jobs = [
                pool.submit(_store, df, f"{path}/daily_{table}", partition, order)
                for table, df, partition, order in tables
            ]
            for job in jobs:
                job.result()
        return cls.read(spark, path)

    @classmethod
    def refresh(cls, attacks: DataFrame, path: str) -> Rollups:
        """Rebuild the days present in ``attacks``, which must hold them whole.

        Other days stay as stored. Tables partitioned by date replace folders;
        the two small ones, of at most one row per day and country, are
        rewritten from a checkpoint of what stays.
        """
        spark = attacks.sparkSession
        base_path = f"{path}/daily_base"
        # The fact is read once; its days come from what was counted.
        fresh = reliable_checkpoint(daily_rollup(attacks, BASE_KEYS))
        rebuild_days(fresh, base_path, ("ip", "username"))
        days = [r["date"] for r in fresh.select("date").distinct().collect() if r["date"]]
        base = spark.read.parquet(base_path).filter(F.col("date").isin(days))
        for table, order in PARTITIONED.items():
            rebuild_days(daily_from_base(base, table), f"{path}/daily_{table}", order)
        for table, fresh, order in (
            ("stats", daily_stats_from_base(base), ("date",)),
            ("country", daily_from_base(base, "country"), ("date", "country")),
        ):
            stored = spark.read.parquet(f"{path}/daily_{table}")
            kept = reliable_checkpoint(stored.filter(~F.col("date").isin(days)))
            _store(kept.unionByName(fresh), f"{path}/daily_{table}", (), order)
        return cls.read(spark, path)


def _store(
    df: DataFrame,
    path: str,
    partition: tuple[str, ...],
    order: tuple[str, ...],
    keep_other_partitions: bool = False,
) -> None:
    (
        df.hint("rebalance", *[F.col(c) for c in (partition or order)])
        .sortWithinPartitions(*partition, *order)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if keep_other_partitions else "static")
        .partitionBy(*partition)
        .parquet(path)
    )


def rebuild_days(rollup: DataFrame, path: str, order: tuple[str, ...]) -> None:
    """Replace the days present in ``rollup`` in a stored table; other days stay."""
    _store(rollup, path, ("date",), order, keep_other_partitions=True)
