from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from siegelog import schema
from siegelog.sources import lake, logs
from tests.data import tuples

HEADER = "Date,Time,IP,Node,Port,PID,Username,Tag,Message\n"

LOOKUP = {
    "10.0.0.1": {
        "cntn": "Asia", "cc": "IN", "cn": "India", "lat": "19.07", "lng": 72.8,
        "asn": {"asn": "AS1", "name": "One", "domain": "one.example", "type": "isp"},
    },
    "10.0.0.2": {"cntn": "Europe", "cc": "DE", "cn": "Germany", "lat": " none ", "lng": "NaN"},
}


@pytest.fixture
def raw(tmp_path):
    for sensor, name, rows in (
        ("clem", "20230105.csv", [
            "20230105,93000,10.0.0.1,node1,22,1,root,ssh,\"said \"\"hi\"\", left\"",
            "20230105,bad,10.0.0.2,node1,22.7,2,,ssh,m",
            "20230231,1,10.0.0.1,node1,22,3,NA,ssh,m",
        ]),
        ("utah", "20230201.csv", [
            "20230201,5.9,10.0.0.9,node2,abc,4,null,ssh,m",
            "abc,1,10.0.0.1,node2,,5,admin,ssh,m",
        ]),
    ):
        folder = tmp_path / "raw" / sensor
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(HEADER + "\n".join(rows) + "\n")
    (tmp_path / "lookup.json").write_text(json.dumps(LOOKUP))
    return tmp_path


def enriched(spark, raw):
    log = logs.normalise(logs.read_logs(spark, str(raw / "raw")))
    return logs.to_attacks(logs.enrich(log, logs.read_lookup(spark, str(raw / "lookup.json"))))


def test_normalise(spark, raw):
    log = logs.normalise(logs.read_logs(spark, str(raw / "raw"))).orderBy("PID")
    assert tuples(log, "datetime", "Time", "Port", "Username") == [
        (dt.datetime(2023, 1, 5), 93000, 22, "root"),
        (dt.datetime(2023, 1, 5), 0, 22, "nan"),
        (None, 1, 22, "nan"),
        (dt.datetime(2023, 2, 1), 5, 0, "nan"),
        (None, 1, 0, "admin"),
    ]


def test_missing_text_may_stay_null(spark, raw):
    log = logs.normalise(logs.read_logs(spark, str(raw / "raw")), missing_text=None)
    assert [r[0] for r in tuples(log.orderBy("PID"), "Username")] == ["root", None, None, None, "admin"]


def test_quotes_and_sensor(spark, raw):
    log = logs.read_logs(spark, str(raw / "raw"), with_file=True).orderBy("PID")
    assert tuples(log, "sensor", "Message")[0] == ("clem", 'said "hi", left')
    assert tuples(log, "sensor")[-1] == ("utah",)


def test_recursive_read(spark, raw):
    deep = raw / "raw" / "clem" / "old" / "older"
    deep.mkdir(parents=True)
    (deep / "20221231.csv").write_text(HEADER + "20221231,1,10.0.0.1,n,22,6,root,ssh,m\n")
    (deep / "notes.txt").write_text("not a log\n")
    assert logs.read_logs(spark, str(raw / "raw")).count() == 5
    assert logs.read_logs(spark, str(raw / "raw"), recursive=True).count() == 6


def test_other_header_is_refused(spark, raw):
    (raw / "raw" / "utah" / "x.csv").write_text("Time,Date,IP,Node,Port,PID,Username,Tag,Message\n1,20230101,a,b,22,7,c,d,e\n")
    with pytest.raises(Exception, match="(?i)header"):
        logs.read_logs(spark, str(raw / "raw")).collect()


def test_lookup(spark, raw):
    rows = tuples(logs.read_lookup(spark, str(raw / "lookup.json")).orderBy("ip"))
    assert rows == [
        ("10.0.0.1", "Asia", "IN", "India", 19.07, 72.8, "AS1", "One", "one.example", "isp"),
        ("10.0.0.2", "Europe", "DE", "Germany", None, None, None, None, None, None),
    ]


def test_lookup_repeats_keep_the_last(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"1.1.1.1": {"cn": "A"}, "1.1.1.1": {"cn": "B"}, "2.2.2.2": {"cn": "C"}}')
    (tmp_path / "b.json").write_text('{"2.2.2.2": {"cn": "D"}}')
    rows = logs.read_lookup(spark, str(tmp_path / "*.json")).orderBy("ip")
    assert tuples(rows, "ip", "country") == [("1.1.1.1", "B"), ("2.2.2.2", "D")]


def test_enrich_keeps_every_row_and_column_order(spark, raw):
    rows = enriched(spark, raw)
    assert rows.columns == [f.name for f in schema.ATTACKS.fields]
    assert [f.dataType for f in rows.schema] == [f.dataType for f in schema.ATTACKS]
    assert tuples(rows.orderBy("PID"), "IP", "country", "asn_name") == [
        ("10.0.0.1", "India", "One"),
        ("10.0.0.2", "Germany", None),
        ("10.0.0.1", "India", "One"),
        ("10.0.0.9", None, None),
        ("10.0.0.1", "India", "One"),
    ]


def test_write_drops_undated_and_prunes(spark, raw):
    rows = enriched(spark, raw)
    assert tuples(lake.undated(rows)) == [(5, 2)]
    assert sorted(tuples(lake.partition_counts(rows))) == [(2023, 1, 2), (2023, 2, 1)]
    path = str(raw / "lake")
    lake.write_attacks(rows, path)
    assert lake.read_attacks(spark, path).count() == 3
    february = lake.read_attacks(spark, path, start="2023-02-01", end="2023-02-01")
    assert [r[0] for r in tuples(february, "PID")] == ["4"]
    plan = february._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    stats = lake.conversion_statistics(spark.read.parquet(path)).orderBy("year", "month")
    assert [(r.year, r.month, r.rows) for r in stats.collect()] == [(2023, 1, 2), (2023, 2, 1)]


def test_compact(spark, raw):
    path, rows = str(raw / "lake"), enriched(spark, raw)
    for pid in ("1", "2", "4"):
        lake.write_attacks(rows.filter(F.col("PID") == pid), path)
    before = sorted(tuples(spark.read.parquet(path)), key=repr)
    report = lake.compact(spark, path, str(raw / "staging"))
    assert tuples(report) == [(2023, 1, 2, 2)]
    spark.catalog.refreshByPath(path)
    assert sorted(tuples(spark.read.parquet(path)), key=repr) == before
    files = lake.conversion_statistics(spark.read.parquet(path)).orderBy("month")
    assert [r.files for r in files.collect()] == [1, 1]
    assert tuples(lake.compact(spark, path, str(raw / "staging2"))) == []


def test_drifting_files_are_united_by_name(spark, raw):
    path, rows = str(raw / "lake"), enriched(spark, raw)
    lake.write_attacks(rows.filter("PID = '1'").drop("Tag"), path)
    lake.write_attacks(rows.filter("PID = '4'"), path)
    merged = lake.read_attacks(spark, path, merge_schema=True)
    assert sorted(tuples(merged, "PID", "Tag")) == [("1", None), ("4", "ssh")]


def test_describe(spark, raw):
    rows = enriched(spark, raw)
    assert lake.describe(rows)[:2] == [("datetime", "timestamp_ntz"), ("year", "int")]
    assert lake.has_column(rows, "username") and not lake.has_column(rows, "nothing")


def test_view(spark, raw):
    lake.attacks_view(enriched(spark, raw), "attacks_under_test")
    assert spark.sql("select count(*) from attacks_under_test").first()[0] == 5
