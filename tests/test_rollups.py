from __future__ import annotations

import datetime as dt
from dataclasses import fields

import pytest
from pyspark.sql import functions as F

from siegelog.operators import rollups as R
from siegelog.plans import quality
from tests import data
from tests.data import tuples

ROWS = [
    ("2024-01-01 01:00:00", "1.1.1.1", "A", "N1", "root", 3),
    ("2024-01-01 23:59:59", "1.1.1.1", "A", "N1", "admin", 1),
    ("2024-01-01 02:00:00", "2.2.2.2", "B", "N1", "root", 2),
    ("2024-01-02 02:00:00", "2.2.2.2", "B", None, "root", 4),
    ("2024-01-02 03:00:00", "3.3.3.3", None, None, "root", 5),
    ("2024-01-03 03:00:00", "4.4.4.4", "", "", None, 2),
    ("2024-01-03 03:00:00", "5.5.5.5", "A", "Unknown", "x", 1),
]


@pytest.fixture(scope="module")
def fact(spark):
    return data.attacks(spark, ROWS).cache()


def total(df):
    return df.agg(F.sum("attacks")).first()[0]


def test_totals_are_the_rows_that_pass_the_filter(fact):
    assert total(R.daily(fact, "country")) == 13
    assert total(R.daily(fact, "asn")) == 6
    assert total(R.daily(fact, "username")) == 7
    assert total(R.daily(fact, "ip")) == 18
    assert total(R.daily(fact, "ip_username")) == 18


def test_base_gives_the_same_rollups(fact):
    base = R.daily_rollup(fact, R.BASE_KEYS)
    for table in R.DAILY:
        direct, derived = R.daily(fact, table), R.daily_from_base(base, table)
        assert sorted(tuples(direct), key=repr) == sorted(tuples(derived, *direct.columns), key=repr)
    assert sorted(tuples(R.daily_stats(fact))) == sorted(tuples(R.daily_stats_from_base(base)))


def test_base_from_log_enriches_after_counting(spark, fact):
    log = fact.select("datetime", "ip", "username")
    lookup = fact.groupBy("ip").agg(
        F.first("country").alias("country"), F.first("asn").alias("asn"),
        F.first("asn_name").alias("asn_name"),
    )
    full = R.daily_rollup(log.join(lookup, "ip"), R.BASE_KEYS)
    for limit in (1, 100):
        base = R.base_from_log(log, lookup, lookup_rows=limit if limit > 1 else None)
        assert sorted(tuples(base, *full.columns), key=repr) == sorted(tuples(full), key=repr)


def test_daily_stats(fact):
    rows = {str(r.date): tuple(r)[1:] for r in R.daily_stats(fact).collect()}
    assert rows == {
        "2024-01-01": (6, 2, 2, 2),
        "2024-01-02": (9, 2, 1, 1),
        "2024-01-03": (3, 2, 2, 1),
    }


def test_build_and_read(spark, fact, tmp_path):
    stored = R.Rollups.build(fact, str(tmp_path))
    derived = R.Rollups.of(fact)
    for field in fields(R.Rollups):
        a, b = getattr(stored, field.name), getattr(derived, field.name)
        assert sorted(tuples(a, *b.columns), key=repr) == sorted(tuples(b), key=repr)
    again = R.Rollups.build(fact.filter("ip = '1.1.1.1'"), str(tmp_path))
    assert total(again.ip) == 4


def test_a_hot_day_is_written_by_several_tasks(spark, tmp_path):
    """The rebalance hint splits a folder that is larger than the advisory size."""
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 3 != 0, F.lit("2024-01-01")).otherwise(F.lit("2024-01-02"))
        .cast("date").alias("date"),
        F.sha2(F.col("id").cast("string"), 256).alias("ip"),
        F.col("id").alias("attacks"),
    ).repartition(8)
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "256KB")
    try:
        R._store(rows, str(tmp_path), ("date",), ("ip",))
    finally:
        spark.conf.set(setting, before)
    files = {d: len(list((tmp_path / f"date=2024-01-0{d}").glob("*.parquet"))) for d in (1, 2)}
    assert files[1] > files[2] >= 1
    assert spark.read.parquet(str(tmp_path)).count() == 40_000


def test_rebuild_replaces_only_its_days(spark, fact, tmp_path):
    R.Rollups.build(fact, str(tmp_path))
    path = str(tmp_path / "daily_ip")
    fixed = spark.read.parquet(path).filter("date = '2024-01-02'").withColumn("attacks", F.col("attacks") * 10)
    fixed = spark.createDataFrame(fixed.collect(), fixed.schema)
    R.rebuild_days(fixed, path, ("ip",))
    days = spark.read.parquet(path).groupBy("date").agg(F.sum("attacks").alias("n")).orderBy("date")
    assert [r.n for r in days.collect()] == [6, 90, 3]


def test_refresh_is_a_build_of_the_changed_log(spark, fact, tmp_path):
    R.Rollups.build(fact, str(tmp_path / "a"))
    second = F.to_date("datetime") == F.lit("2024-01-02")
    changed = fact.filter(~second).unionByName(fact.filter(second).filter("ip != '3.3.3.3'"))
    refreshed = R.Rollups.refresh(changed.filter(second), str(tmp_path / "a"))
    rebuilt = R.Rollups.build(changed, str(tmp_path / "b"))
    for field in fields(R.Rollups):
        a, b = getattr(refreshed, field.name), getattr(rebuilt, field.name)
        assert sorted(tuples(a, *b.columns), key=repr) == sorted(tuples(b), key=repr), field.name


def test_merge(spark):
    one = spark.createDataFrame([("a", 1, 5, 9), ("b", 2, 1, 1)], "k string, attacks long, first_seen int, last_seen int")
    two = spark.createDataFrame([("a", 10, 3, 8)], "k string, attacks long, first_seen int, last_seen int")
    assert sorted(tuples(R.merge_rollups(one, two, keys=("k",)))) == [("a", 11, 3, 9), ("b", 2, 1, 1)]
    with pytest.raises(ValueError, match="unique_ips"):
        R.merge_rollups(one.withColumn("unique_ips", F.lit(1)), keys=("k",))


def test_duplicates(spark):
    parts = spark.createDataFrame([("d1", "a", 1), ("d1", "a", 2), ("d1", "b", 1), ("d2", "a", 1)], "date string, ip string, attacks long")
    assert sorted(tuples(R.rollup_duplicates(parts, ("date", "ip")))) == [("d1", 3, 2, 1), ("d2", 1, 1, 0)]


def test_overall_statistics(fact):
    top = tuples(R.top_ips(fact, 2), "ip", "country", "attack_count", "unique_usernames")
    assert top == [("2.2.2.2", "B", 6, 1), ("3.3.3.3", "Unknown", 5, 1)]
    names = tuples(R.username_stats(fact, 1), "username", "attempt_count", "unique_ips", "unique_countries")
    assert names == [("root", 14, 3, 2)]
    assert {r.hour: r.attack_count for r in R.hourly_patterns(fact).collect()} == {1: 3, 2: 6, 3: 8, 23: 1}


def test_hot_countries_keep_exact_counts(spark):
    rows = [("2024-01-01", f"1.1.{i // 200}.{i % 200}", "A", "N", f"u{i % 3}", 1) for i in range(600)]
    stats = R.country_stats(
        data.attacks(spark, rows + [("2024-01-01", "9.9.9.9", "B", "N", "u", 1)])
        .withColumns({"country_code": F.lit("C"), "continent": F.lit("X"),
                      "latitude": F.lit(1.0), "longitude": F.lit(2.0)})
    )
    assert sorted(tuples(stats, "country", "total_attacks", "unique_ips", "unique_usernames")) == [
        ("A", 600, 600, 3), ("B", 1, 1, 1),
    ]


def test_reconcile(spark):
    def verdict(rollup, stats):
        table = spark.createDataFrame([(rollup,)], "attacks long")
        return quality.reconcile(table, spark.createDataFrame([(stats,)], "total_attacks long")).first()

    assert verdict(10_000, 10_999).verdict == "match"
    assert verdict(995_000, 1_000_000).verdict == "close"
    assert tuple(verdict(900_000, 1_000_000))[1:] == (1_000_000, 900_000, 100_000, 10.0, "different")


def test_sketches_merge(spark):
    one = [("2024-01-01", f"1.1.1.{i}", "A", "N", "u", 1) for i in range(200)]
    two = [("2024-01-01", f"1.1.1.{i}", "B", "N", "v", 1) for i in range(100, 250)]
    parts = [R.daily_sketches(data.attacks(spark, rows)) for rows in (one, two)]
    row = R.estimates(R.merge_rollups(*parts, keys=("date",))).first()
    assert (row.total_attacks, row.unique_countries, row.unique_usernames) == (350, 2, 2)
    assert abs(row.unique_ips - 250) <= 10


def test_labels_are_chosen_after_hash_aggregation(fact):
    """No plan sorts the log itself."""
    plans = [
        R.top_ips(fact, None),
        R.country_stats(
            fact.withColumns({"country_code": F.lit("C"), "continent": F.lit("X"),
                              "latitude": F.lit(1.0), "longitude": F.lit(2.0)})
        ),
        R.username_stats(fact, None),
        R.daily_stats(fact),
    ]
    for df in plans:
        plan = df._jdf.queryExecution().sparkPlan().toString()
        scan_side = [line for line in plan.splitlines() if "Aggregate" in line][-1]
        assert "HashAggregate" in scan_side and "SortAggregate" not in scan_side


def test_daily_addresses_from_the_log_are_grouped_once(spark):
    """Repeated, null and unknown addresses as by way of the base grain, in tasks of a bounded number of rows."""
    day = lambda n: None if n is None else dt.datetime(2024, 1, n, 5)
    log = [(day(n), ip, u) for n in (1, 2, None) for ip in ("a", "b", "c", None) for u in ("x", "x", "y", None)]
    labels = [("a", "C1", "AS1", "N1"), ("a", "C1", "AS2", "N1"), ("a", "C1", "AS2", None), ("b", None, None, None), (None, "C9", "AS9", "N9"), ("d", "C4", "AS4", "N4")]
    logged = spark.createDataFrame(log, "datetime timestamp_ntz, ip string, username string")
    known = spark.createDataFrame(labels, "ip string, country string, asn string, asn_name string")
    base = R.base_from_log(logged, known, len(labels), unique=True)
    want = sorted(map(repr, map(tuple, R.daily_from_base(base, "ip").collect())))
    direct = R.Rollups.of_log(logged, known, 10**8, len(labels), unique=True).ip
    assert sorted(map(repr, map(tuple, direct.collect()))) == want
    plan = direct._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(date" in plan and ", 400)" in plan
    assert not any("username" in line for line in plan.splitlines() if "Aggregate" in line)
    once = known.filter("ip = 'b'")
    assert R.daily_ip_from_log(logged, once, len(log)).count() == 12
    with pytest.raises(Exception, match="key comes twice"):
        R.daily_ip_from_log(logged, known, len(log)).collect()
