"""Stored sets of entities and posting lists against plain counts and searches."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siegelog.operators import bitmaps
from siegelog.operators.bitmaps import EntitySets
from siegelog.operators.name_index import NameIndex, grams_of

FIRST = dt.date(2024, 1, 1)


def visits(days=40, ips=70_000, rows=4_000, seed=1):
    pick = random.Random(seed)
    out = [(FIRST + dt.timedelta(pick.randrange(days)), f"ip{pick.randrange(ips)}", pick.choice(["A", "B", None])) for _ in range(rows)]
    return [*out, (FIRST, None, "A"), (None, "ip1", "A"), *out[:50]]


def frame(spark, rows):
    return spark.createDataFrame(rows, "date date, ip string, country string")


def brute(rows, start, end, group=lambda r: ()):
    found: dict = {}
    for r in rows:
        if r[0] is not None and start <= r[0] <= end:
            found.setdefault(group(r), set())
            if r[1] is not None:
                found[group(r)].add(r[1])
    return {k: len(v) for k, v in found.items() if v}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rows = visits()
    # numbers over several buckets: every value of a wider dictionary is known first
    wide = [(FIRST, f"ip{k}", "A") for k in range(70_000)]
    sets = EntitySets(str(tmp_path_factory.mktemp("sets")), "ip", ("country",))
    sets.build(frame(spark, wide)).refresh(frame(spark, rows))
    return sets, rows


def test_numbers_are_dense_and_stay(spark):
    first = bitmaps.number_entities(frame(spark, visits()), "ip")
    again = bitmaps.number_entities(frame(spark, visits(seed=2)), "ip", first)
    a, b = ({r.ip: r.number for r in x.collect()} for x in (first, again))
    assert sorted(a.values()) == list(range(1, len(a) + 1))
    assert all(b[k] == v for k, v in a.items())
    assert sorted(b.values()) == list(range(1, len(b) + 1)) and set(b) == {r[1] for r in visits() + visits(seed=2)} - {None}


@pytest.mark.parametrize("start, end", [(0, 39), (0, 0), (5, 17), (39, 60), (50, 60)])
def test_unique_of_a_range(spark, stored, start, end):
    sets, rows = stored
    a, b = FIRST + dt.timedelta(start), FIRST + dt.timedelta(end)
    assert {(r.country,): r.entities for r in sets.unique(spark, str(a), str(b)).collect()} == brute(rows, a, b, lambda r: (r[2],))
    assert {r.bucket for r in sets.daily(spark).select("bucket").distinct().collect()} == {1, 2, 3}


def test_unique_by_period(spark, stored):
    sets, rows = stored
    got = {(r.period, r.country): r.entities for r in sets.unique_by(spark, F.trunc("date", "week")).collect()}
    assert got == brute(rows, FIRST, dt.date(2030, 1, 1), lambda r: (r[0] - dt.timedelta(r[0].weekday()), r[2]))


def test_returning(spark, stored):
    sets, rows = stored
    cut = FIRST + dt.timedelta(20)
    a, b = {}, {}
    for date, ip, country in rows:
        if date and ip:
            (a if date <= cut else b).setdefault(country, set()).add(ip)
    day = dt.timedelta(1)
    got = sets.returning(spark, (str(FIRST), str(cut)), (str(cut + day), str(cut + 90 * day))).collect()
    assert {r.country: (r.both, r.only_first, r.only_second) for r in got} == {
        c: (len(a[c] & b[c]), len(a[c] - b[c]), len(b[c] - a[c])) for c in a
    }


def test_refresh_replaces_days(spark, tmp_path):
    sets = EntitySets(str(tmp_path / "s"), "ip").build(frame(spark, [(FIRST, "a", ""), (FIRST, "b", ""), (FIRST + dt.timedelta(1), "a", "")]))
    before = {r.ip: r.number for r in sets.numbers(spark).collect()}
    sets.refresh(frame(spark, [(FIRST, "c", ""), (FIRST, "a", "")]))
    after = {r.ip: r.number for r in sets.numbers(spark).collect()}
    assert after == {**before, "c": 3}
    assert sets.unique(spark).first().entities == 2
    assert sets.unique(spark, "2030-01-01").first().entities == 0


def test_stored_sets_read_neither_log_nor_entities(spark, stored):
    sets, _ = stored
    plan = sets.unique(spark, "2024-01-03", "2024-01-09")._jdf.queryExecution().executedPlan().toString()
    assert "numbers" not in plan and "PartitionFilters: [isnotnull(date" in plan and "Join" not in plan


NAMES = ["10.0.0.1", "10.0.0.12", "Root", "root", "ROOT_2", "a", "ab", "", "İstanbul", "naïve", "\U0001f600\U0001f600x", "aaaa", "aab", "%_\\", "x" * 400, None]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    names = spark.createDataFrame([(n,) for n in NAMES + [f"user{k}" for k in range(40_000)]], "name string")
    return NameIndex(str(tmp_path_factory.mktemp("names")), "name").build(names)


@pytest.mark.parametrize("text", ["", "1", "0.", "0.0", "0.0.1", "10.0.0.12", "ROOT", "oot_", "aa", "aaa", "aaaa", "aaaaa", "ï", "\U0001f600x", "%_\\", "user39999", "r399", "xxxx", "zzz", "user1 "])
def test_search_is_contains(spark, index, text):
    names = spark.read.parquet(f"{index.path}/names")
    want = sorted(r.name for r in names.filter(F.lower("name").contains(text.lower())).collect())
    assert sorted(r.name for r in index.search(spark, text).collect()) == want
    # the lists leave few names to verify
    assert not text or index.candidates(spark, text).count() <= 2 * len(want) + 20


def test_grams():
    assert grams_of("") == [] and grams_of("Ab") == ["ab"] and grams_of("abcab") == ["abc", "bca", "cab"]


def test_search_reads_the_lists_of_its_grams(spark, index):
    plan = index.search(spark, "user39")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan
