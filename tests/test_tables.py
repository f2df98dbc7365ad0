from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from siegelog.operators.rollups import Rollups
from siegelog.plans import tables
from siegelog.plans.endpoints import ENDPOINTS, answer, filters_from
from siegelog.plans.filters import Filters
from siegelog.plans.series import series
from tests import data
from tests.data import tuples

ROWS = [
    ("2022-11-01 05:00:00", "1", "A", "N1", "root", 3),
    ("2022-11-02 05:00:00", "1", "A", "N1", "root", 6),
    ("2022-11-01 06:00:00", "2", "B", "N2", "admin", 2),
]


@pytest.fixture(scope="module")
def fact(spark):
    return data.attacks(spark, ROWS).withColumns(
        {"country_code": F.col("country"), "continent": F.lit("X"), "latitude": F.lit(1.0),
         "longitude": F.lit(None).cast("double")}
    )


def test_stored_tables_answer_sql(spark, fact, tmp_path):
    tables.build(fact, str(tmp_path))
    tables.register(spark, str(tmp_path))
    sql = lambda text: tuples(spark.sql(text))
    assert sql("select country, sum(attacks) from daily_country_attacks group by 1 order by 1") == [("A", 9), ("B", 2)]
    assert sql("select ip, max_volatility from volatile_ip_summary") == [("1", 100.0)]
    assert sql("select hour, attack_count from hourly_patterns order by 1") == [(5, 9), (6, 2)]
    assert sql("select country, avg_latitude, avg_longitude from country_stats order by 1") == [
        ("A", 1.0, None), ("B", 1.0, None),
    ]
    assert sql("select total_attacks from daily_stats order by date") == [(5,), (6,)]
    assert sql("select ip, attack_count from top_ips limit 1") == [("1", 9)]
    assert sql("select username, unique_ips from username_stats order by 1") == [("admin", 1), ("root", 1)]
    assert sql("select country, days_measured from country_volatility") == [("A", 1)]


def test_filters_reach_the_scan(spark, fact, tmp_path):
    """Dates prune folders, entities prune row groups, unread columns are not read."""
    r = Rollups.build(fact, str(tmp_path))
    lines = series(r, "total", Filters.of("2022-11-01", "2022-11-01", ip="1"))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(date" in scan and "(date" in scan
    assert "EqualTo(ip,1)" in scan
    assert "ReadSchema: struct<ip:string,attacks:bigint>" in scan
    assert tuples(lines) == [("2022-11-01", 3)]
    assert r.ip.select("date").distinct().count() == 2
    assert {x[0] for x in tuples(r.ip, "date")} == {dt.date(2022, 11, 1), dt.date(2022, 11, 2)}


def test_plural_wins_where_lists_are_read():
    params = {"country": "A|||B", "countries": "C|||D"}
    assert filters_from(params).country == ("A|||B",)
    assert filters_from(params, lists=True).country == ("C", "D")


def test_every_endpoint_answers(fact):
    r = Rollups.of(fact)
    for name in ENDPOINTS:
        answer(r, name, {"start": "2022-11-01", "end": "2022-11-02"}).collect()
    assert tuples(answer(r, "date_range", {})) == [("2022-11-01", "2022-11-02")]
    assert tuples(answer(r, "ip_count", {})) == [(2,)]
    assert answer(r, "total_attacks", {"ip": "1"}).count() == 69
    assert [x.ip for x in answer(r, "ip_summary", {"limit": "1", "offset": "1"}).collect()] == ["2"]
    networks = answer(r, "asn_attacks", {"countries": "A|||B", "end": "2022-11-01"})
    assert sorted(tuples(networks)) == [("2022-11-01", "N1", "A", 3), ("2022-11-01", "N2", "B", 2)]


def test_build_reads_the_fact_once(spark, tmp_path):
    rows = [Row(datetime=dt.datetime(2024, 1, 1 + k % 3, k % 24), ip=f"i{k % 7}", username=f"u{k % 5}", country="C", country_code="c", continent="X", latitude=1.0, longitude=2.0, asn="A", asn_name="N") for k in range(120)]
    seen = spark.sparkContext.accumulator(0)

    def counted(row):
        seen.add(1)
        return row

    fact = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(counted), spark.createDataFrame(rows[:1]).schema)
    tables.build(fact, str(tmp_path))
    assert seen.value == 120
    assert spark.read.parquet(f"{tmp_path}/country_stats").first().unique_ips == 7
    assert spark.read.parquet(f"{tmp_path}/hourly_patterns").count() == 24
