from __future__ import annotations

import random

import pytest

from siegelog.operators import joins
from tests.data import tuples


def sides(spark):
    """One key holds half of the rows, some keys are NULL, some are unknown."""
    pick = random.Random(7)
    left = [(i, "hot" if i % 2 else pick.choice([None, "a", "b", "c", "d", "unknown"])) for i in range(400)]
    right = [("hot", 1), ("a", 2), ("b", 3), ("c", 4), ("d", None), ("unused", 6)]
    known = dict(right)
    expected = sorted((i, k, known.get(k)) for i, k in left)
    return (
        spark.createDataFrame(left, "i int, k string").repartition(4),
        spark.createDataFrame(right, "k string, v int"),
        expected,
    )


def test_all_paths_agree(spark):
    left, right, expected = sides(spark)
    by_i = lambda df: sorted(tuples(df), key=lambda r: r[0])
    assert by_i(joins.lookup_join(left, right, "k")) == expected
    assert by_i(joins.lookup_join(left, right, "k", right_rows=6)) == expected
    assert by_i(joins.lookup_join(left, right, "k", max_rows=2)) == expected
    assert by_i(joins.skewed_join(left, right, "k")) == expected


def test_each_side_is_read_once(spark, tmp_path):
    left, right, expected = sides(spark)
    left.write.parquet(f"{tmp_path}/left")
    right.write.parquet(f"{tmp_path}/right")
    joined = joins.skewed_join(spark.read.parquet(f"{tmp_path}/left"), spark.read.parquet(f"{tmp_path}/right"), "k")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2
    assert sorted(tuples(joined)) == expected


def test_repeated_keys_are_refused(spark):
    _, right, _ = sides(spark)
    assert sorted(tuples(joins.one_per_key(right, "k")), key=repr) == sorted(tuples(right), key=repr)
    with pytest.raises(Exception, match="key comes twice: a"):
        joins.one_per_key(right.union(right.filter("k = 'a'")), "k").collect()


def test_large_right_side_is_not_broadcast_whole(spark):
    left, right, _ = sides(spark)
    joined = joins.lookup_join(left, right, "k", right_rows=10**9)
    assert joined.columns == ["i", "k", "v"]
    assert tuples(joined.filter("k = 'hot'").agg({"i": "count"})) == [(200,)]


def test_several_keys(spark):
    left = spark.createDataFrame([(1, "x", 1), (2, "x", 2), (3, None, 1), (4, "y", None)], "i int, a string, b int")
    right = spark.createDataFrame([("x", 1, "p"), ("y", 1, "q")], "a string, b int, v string")
    expected = [(1, "x", 1, "p"), (2, "x", 2, None), (3, None, 1, None), (4, "y", None, None)]
    assert sorted(tuples(joins.skewed_join(left, right, "a", "b"))) == expected


def test_lookup_refuses_repeated_keys_unless_known_unique(spark):
    left, right, expected = sides(spark)
    twice = right.union(right.filter("k = 'a'"))
    for rows in (None, 6, 10**9):
        with pytest.raises(Exception, match="key comes twice: a"):
            joins.lookup_join(left, twice, "k", right_rows=rows).collect()
        assert len(joins.lookup_join(left, right, "k", right_rows=rows, unique=True).collect()) == len(expected)
    nulls = right.union(spark.createDataFrame([(None, 1), (None, 2)], "k string, v int"))
    assert sorted(tuples(joins.lookup_join(left, nulls, "k")), key=lambda r: r[0]) == expected


def test_size_counts_bytes(spark):
    from siegelog.functions.scale import has_at_most

    wide = spark.range(10).selectExpr("id", "repeat('x', 1000) as text", "cast(null as string) as none")
    assert has_at_most(wide, 10) and not has_at_most(wide, 9)
    assert has_at_most(wide, 10, 10 * (1000 + 48)) and not has_at_most(wide, 10, 10 * (1000 + 48) - 1)
    assert has_at_most(wide.limit(0), 0, 0)
