from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siegelog.operators import ranking as K
from siegelog.operators import sets, topn
from tests.data import tuples

SCHEMA = "ip string, total_attacks long, max_pct_change double, first_seen string"


def table(seed: int, size: int):
    """Half of the rows share one value; some metrics are NULL."""
    pick = random.Random(seed)
    return [
        (
            f"Ip{i:03d}",
            1 if i % 2 else pick.randint(1, 9),
            pick.choice([None, 0.0, -5.5, 12.25, float(pick.randint(0, 50))]),
            pick.choice(["2024-01-01", "2024-01-02", "2024-02-01", None]),
        )
        for i in range(size)
    ]


def competition_ranks(values, ascending):
    """1 + number of strictly better values; NULL is worse than any."""
    worst = float("inf")
    keyed = [worst if v is None else (v if ascending else -v) for v in values]
    return [1 + sum(other < mine for other in keyed) for mine in keyed]


@pytest.fixture(params=[2, K.CUTS])
def cuts(request, monkeypatch):
    """Few ranges of many values, or many of few."""
    monkeypatch.setattr(K, "CUTS", request.param)


@pytest.mark.parametrize("seed", [1, 2])
def test_average_rank(spark, cuts, seed):
    rows = table(seed, 120)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    metrics = ["total_attacks", "max_pct_change", "first_seen", "ip"]
    number = lambda text: None if text is None else int(text.replace("-", ""))
    columns = [
        competition_ranks([r[1] for r in rows], False),
        competition_ranks([r[2] for r in rows], False),
        competition_ranks([number(r[3]) for r in rows], True),
        competition_ranks([int(r[0][2:]) for r in rows], True),
    ]
    expected = {
        r[0]: (*ranks, sum(ranks) / 4.0) for r, *ranks in zip(rows, *columns)
    }
    ranked = K.average_rank(df, metrics, "ip")
    got = ranked.collect()
    assert {
        x.ip: (*[x[f"rank_{m}"] for m in metrics], x.avg_rank) for x in got
    } == expected
    order = [(x.avg_rank, -x.total_attacks, x.ip) for x in got]
    assert order == sorted(order)
    worst_first = K.average_rank(df, metrics, "ip", best_first=False).collect()
    assert [x.avg_rank for x in worst_first] == sorted([x.avg_rank for x in got], reverse=True)
    best = K.rank_breakdown(ranked, "ip", 5).collect()
    assert [x.ip for x in best] == [x.ip for x in got[:5]]
    assert [x.final_rank for x in best] == [1, 2, 3, 4, 5]


def test_ranks_do_not_depend_on_layout(spark, cuts):
    rows = table(3, 60)
    one = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    other = spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)
    get = lambda df: sorted(tuples(K.ranks(df, "ip", ["total_attacks", "max_pct_change"])))
    assert get(one) == get(other)


def test_ranking_has_no_single_task_window_over_the_rows(spark):
    df = spark.createDataFrame(table(4, 60), SCHEMA)
    plan = K.average_rank(df, ["total_attacks"], "ip")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "WindowGroupLimit" in plan  # the cuts are picked before they are shuffled


def test_positions(spark):
    rows = table(5, 200)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    order = [F.desc("total_attacks"), F.asc("ip")]
    expected = [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))]
    placed = K.with_position(df, order).orderBy("position").collect()
    assert [(x.position, x.ip) for x in placed] == list(enumerate(expected, 1))


@pytest.mark.parametrize("head_rows", [K.HEAD_ROWS, 10])
def test_pages(spark, monkeypatch, head_rows):
    """The same pages from the head of the sort and from positions."""
    monkeypatch.setattr(K, "HEAD_ROWS", head_rows)
    rows = table(6, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    order = [F.desc("total_attacks"), F.asc("ip")]
    expected = list(enumerate([r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))], 1))
    for number, size in ((1, 25), (2, 25), (3, 25), (4, 25)):
        page = K.page(df, order, number, size).orderBy("position")
        assert [(x.position, x.ip) for x in page.collect()] == expected[(number - 1) * size : number * size]
    assert tuples(K.page_count(df, 25)) == [(60, 3)]


def test_sort_puts_nulls_last_either_way(spark):
    df = spark.createDataFrame([("b", 1.0), ("A", None), ("c", 3.0)], "ip string, max_pct_change double")
    names = lambda *a, **k: [r[0] for r in tuples(K.sort_by(df, *a, **k), "ip")]
    assert names("max_pct_change") == ["c", "b", "A"]
    assert names("max_pct_change", desc=False) == ["b", "c", "A"]
    assert names("ip", desc=False) == ["A", "b", "c"]


def test_search(spark):
    df = spark.createDataFrame([("United States",), ("Mozambique",), (None,)], "country string")
    assert tuples(K.search(df, "country", "uNiTed")) == [("United States",)]
    assert K.search(df, "country", "").count() == 3
    assert tuples(K.search(df, "country", "%")) == []


def test_compare_and_overlap(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",)], "k string")
    b = spark.createDataFrame([("y",), ("z",)], "k string")
    assert sorted(tuples(sets.compare_top(a, b, "k"))) == [("x", "only_a"), ("y", "only_a"), ("z", "only_b")]
    assert tuples(sets.compare_top(a, a, "k")) == []
    assert sorted(tuples(sets.overlap(a.distinct(), b, "k"))) == [("x", "only_a"), ("y", "both"), ("z", "only_b")]


def test_largest_per_group(spark):
    rows = [("hot", f"e{i:03d}", i % 50) for i in range(300)] + [("cold", "only", 1), (None, "x", 9), ("cold", None, 9)]
    facts = spark.createDataFrame(rows, "g string, e string, attacks long")
    got = sorted(tuples(topn.largest_per_group(facts, "g", "e", 2)))
    assert got == [("cold", "only", 1, 1), ("hot", "e049", 49, 1), ("hot", "e099", 49, 2)]
