from __future__ import annotations

from siegelog.operators.rollups import Rollups
from siegelog.plans import quality, reports
from siegelog.plans.filters import Filters
from siegelog.plans.volatility import most_volatile
from tests import data
from tests.data import tuples

ROWS = [
    ("2024-01-01", "1", "A", "N1", "root", 6),
    ("2024-01-01", "2", "B", "N2", "root", 2),
    ("2024-01-02", "2", "B", "N1", "admin", 1),
    ("2024-01-08", "3", None, None, "admin", 1),
    ("2024-01-08", "4", "Unknown", "None", "x", 2),
]


def test_coverage(spark):
    fact = data.attacks(spark, ROWS)
    got = sorted(tuples(quality.coverage(fact, ["country", "asn_name"])))
    assert got == [("asn_name", 12, 11, 91.7, 1), ("country", 12, 11, 91.7, 1)]


def test_coverage_by_file(spark, tmp_path):
    fact = data.attacks(spark, ROWS)
    fact.filter("country is not null").coalesce(1).write.parquet(str(tmp_path / "x"))
    fact.filter("country is null").coalesce(1).write.mode("append").parquet(str(tmp_path / "x"))
    rows = quality.coverage_by_file(spark.read.parquet(str(tmp_path / "x")), ["country"])
    assert sorted(tuples(rows, "rows", "filled", "enough")) == [(1, 0, 0), (11, 11, 1)]


def test_quality_counts(spark):
    got = dict(tuples(quality.quality_counts(data.attacks(spark, ROWS))))
    assert got["Total Records"] == 12 and got["Missing Country Info"] == 3
    assert got["Missing ASN Info"] == 1


def test_profile(spark):
    fact = data.attacks(spark, ROWS)
    got = {r[0]: r[1:] for r in tuples(quality.profile(fact, ["ip", "country"]))}
    assert got["ip"] == ("string", 12, 12, 4, "1", "4")
    assert got["country"] == ("string", 12, 11, 3, "A", "Unknown")
    top = sorted(tuples(quality.top_values(fact, ["ip"], 2)))
    assert top == [("ip", "1", 6, 1), ("ip", "2", 3, 2)]


def test_breakdown(spark):
    r = data.rollups(spark, ROWS)
    got = sorted(tuples(quality.breakdown(r.ip_username, "username", "admin")))
    assert got == [
        ("asn", "N1", 1), ("country", "B", 1), ("date", "2024-01-02", 1), ("date", "2024-01-08", 1),
        ("ip", "2", 1), ("ip", "3", 1),
    ]
    assert sorted(tuples(quality.breakdown(r.ip, "ip", "2"), "dimension", "attacks")) == [
        ("asn", 1), ("asn", 2), ("country", 3), ("date", 1), ("date", 2),
    ]


def test_day_sample(spark):
    r = data.rollups(spark, ROWS)
    assert tuples(quality.day_sample(r.asn, "asn_name", "2024-01-01", n=1)) == [("N1", 6)]
    assert tuples(quality.day_sample(r.asn, "asn_name", "2024-01-01", by="country", text="2")) == [("N2", "B", 2)]
    assert tuples(quality.day_sample(r.username, "username", "2024-01-01", by="country", value="root")) == [
        ("root", "A", 6), ("root", "B", 2),
    ]


def test_reconcile_all(spark):
    verdicts = {x.rollup: x.difference for x in quality.reconcile_all(data.rollups(spark, ROWS)).collect()}
    assert verdicts == {
        "daily_country": 1, "daily_asn": 1, "daily_username": 1, "daily_ip": 0, "daily_ip_username": 0,
    }


def test_reports(spark):
    fact = data.attacks(spark, ROWS)
    r = Rollups.of(fact)
    assert tuples(reports.weekly_trend(r.stats)) == [("2024-01-08", 3, 2.0), ("2024-01-01", 9, 1.5)]
    assert tuples(reports.latest_days(r.stats, 1)) == [("2024-01-08", 3, 2)]
    assert tuples(reports.by_label(fact, "asn_name", 1)) == [("N1", 7, 2)]
    period = Filters.of("2024-01-01", "2024-01-08")
    assert tuples(reports.top_entities(r, "ip", period, 2)) == [("1", 6), ("2", 3)]
    chosen = most_volatile(r.country, "country", 5)
    assert tuples(reports.networks_of_countries(r, period, chosen, 5)) == [("N2", 2), ("N1", 1)]
