"""Blocks of days against summaries and volatility of the days themselves."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siegelog.operators import spans
from siegelog.operators.rollups import Rollups
from siegelog.operators.spans import DayBlocks
from siegelog.plans import blocks as B
from siegelog.plans import summary, volatility

FIRST = dt.date(2024, 2, 27)
TEN = [
    "total_attacks", "avg_daily", "first_seen", "last_seen", "max_daily", "max_absolute_change", "max_pct_change",
    "persistence_pct", "recent_attacks", "active_days",
]


def day(n):
    return FIRST + dt.timedelta(n)


def log_rows(seed=3, days=150):
    pick = random.Random(seed)
    out = []
    for k in range(25):
        share = pick.choice([0.02, 0.2, 0.9])
        out += [(day(n), f"e{k}", pick.choice([1, 2, 3, 50, 1000])) for n in range(days) if pick.random() < share]
    return out + [(day(3), "once", 7), (day(0), "ends", 5), (day(days - 1), "ends", 9), (day(4), None, 3), (day(5), "Unknown", 3)]


def rollups(spark, rows):
    """The same lines as countries, networks, addresses and usernames."""
    table = spark.createDataFrame(rows, "date date, e string, attacks long")
    columns = {"country": ["country"], "asn": ["asn_name"], "ip": ["ip"], "username": ["username"]}
    tables = {}
    for name, (entity,) in columns.items():
        others = [c for c in ("country", "asn_name") if c != entity]
        tables[name] = table.select("date", F.col("e").alias(entity), *[F.lit("x").alias(c) for c in others], "attacks")
    return Rollups(stats=table, ip_username=table, **tables)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    tables = rollups(spark, log_rows())
    path = tmp_path_factory.mktemp("blocks")
    return tables, {d: B.build_blocks(tables, d, str(path / d), 200) for d in ("country", "ip")}


@pytest.mark.parametrize("start, end", [(0, 0), (0, 149), (1, 148), (3, 3), (37, 101), (64, 127), (-20, 30), (140, 180), (160, 170), (-9, -3)])
@pytest.mark.parametrize("dim", ["country", "ip"])
def test_summary_of_any_range(spark, stored, dim, start, end):
    tables, kept = stored
    entity = kept[dim].entity
    want = summary.entity_summary(tables, dim, day(start), day(end)).select(entity, *TEN).collect()
    got = B.block_summary(spark, kept[dim], dim, day(start), day(end)).select(entity, *TEN).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("start, end", [(0, 149), (10, 77)])
def test_volatility_of_any_range(spark, stored, start, end):
    tables, kept = stored
    inside = F.col("date").between(F.lit(day(start)), F.lit(day(end)))
    part = Rollups(**{n: getattr(tables, n).filter(inside) for n in ("stats", "country", "asn", "username", "ip", "ip_username")})
    for dim in ("country", "ip"):
        want = sorted(map(tuple, volatility.volatility_summary(part, dim).collect()))
        assert sorted(map(tuple, B.block_volatility(spark, kept[dim], day(start), day(end)).collect())) == want
    want = {r.country: r for r in volatility.country_volatility(part).collect()}
    got = {r.country: r for r in B.block_spread(spark, kept["country"], day(start), day(end)).collect()}
    assert set(got) == set(want)
    for name, row in want.items():
        assert [x is None for x in got[name]] == [x is None for x in row]
        assert [x or 0 for x in got[name][1:]] == pytest.approx([x or 0 for x in row[1:]], rel=1e-9)


@pytest.mark.parametrize("changed", [[0, 1, 149, 150, 151], [63, 64, 65], [40], [-1, -70, 200]])
def test_refresh_equals_a_full_rebuild(spark, tmp_path, changed):
    """Days replaced, added and emptied, inside and at both ends."""
    before, pick = log_rows(), random.Random(len(changed))
    dates = {day(n) for n in changed}
    after = [r for r in before if r[0] not in dates]
    after += [(day(n), f"e{k}", pick.randrange(1, 99)) for n in changed[1:] or changed for k in range(0, 25, 2) if n != 40]
    kept = B.build_blocks(rollups(spark, before), "ip", str(tmp_path / "a"), 256)
    kept.refresh(B.entity_days(rollups(spark, after), "ip"), dates)
    fresh = B.build_blocks(rollups(spark, after), "ip", str(tmp_path / "b"), 256)
    for level in range(kept.levels + 1):
        a, b = (sorted(map(repr, x.level(spark, level).select("ip", "block", *spans.STATE).collect())) for x in (kept, fresh))
        assert a == b


def test_refresh_leaves_other_partitions(spark, tmp_path):
    kept = B.build_blocks(rollups(spark, log_rows()), "ip", str(tmp_path / "a"), 256)
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "a").rglob("*.parquet")}
    kept.refresh(B.entity_days(rollups(spark, log_rows()), "ip"), [day(100)])
    same = {p.parent.name for p in stamps if p.exists()}
    gone = {p.parent.name for p in stamps if not p.exists()}
    assert same - gone and spans.number_of(day(100)) >> spans.ERA in {int(x.removeprefix("era=")) for x in gone}


def test_cover():
    pick = random.Random(0)
    for _ in range(200):
        a = pick.randrange(-2000, 2000)
        b = a + pick.randrange(0, 1500)
        got = spans.cover(spans.EPOCH + dt.timedelta(a), spans.EPOCH + dt.timedelta(b), 8)
        days = [x for level, block in got for x in range(block << level, (block + 1) << level)]
        assert days == list(range(a, b + 1))
        assert len(got) <= 16 + (b - a) // 256 + 1
    assert spans.cover(day(3), day(2), 4) == []


def test_empty_log(spark, tmp_path):
    none = rollups(spark, log_rows()[:1])
    empty = Rollups(**{n: getattr(none, n).limit(0) for n in ("stats", "country", "asn", "username", "ip", "ip_username")})
    kept = B.build_blocks(empty, "country", str(tmp_path), 30)
    assert B.block_summary(spark, kept, "country", day(0), day(9)).count() == 0
    assert isinstance(kept, DayBlocks) and kept.refresh(B.entity_days(none, "country"), [log_rows()[0][0]]) is kept
    assert B.block_summary(spark, kept, "country", day(0), day(150)).count() == 1


def test_levels_are_shuffled_once(spark, tmp_path):
    """Each level is what an aggregation of the level below gives, of one shuffle and no sort aggregate."""
    days = B.entity_days(rollups(spark, log_rows()), "ip")
    kept = DayBlocks(str(tmp_path / "ip"), "ip", 9).build(days)
    for level in range(1, 10):
        below = kept.level(spark, level - 1).withColumn("block", F.shiftright("block", 1))
        want = spans.combined(below, "ip", "block").select("ip", "block", *spans.STATE)
        got = kept.level(spark, level)
        assert sorted(map(repr, got.select("ip", "block", *spans.STATE).collect())) == sorted(map(repr, want.collect()))
        assert got.filter(F.col("era") != F.shiftright(F.shiftleft("block", level), spans.ERA)).count() == 0
    dealt = kept.level(spark, 0).withColumn("part", F.pmod(F.xxhash64("ip"), F.lit(2))).repartition(4, "era", "part")
    plan = spans.paired(dealt, "era", "block", "ip", "part")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
