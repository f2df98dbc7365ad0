from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siegelog.functions import expressions as X
from siegelog.functions.dates import calendar, days_between, to_day
from tests.data import tuples


def values(spark, texts, build):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(build("t")).collect()]


def test_safe_double(spark):
    texts = ["12.5", " 7 ", "-1e3", "NaN", " none ", "", "NULL", None, "abc", "12d", "1,5"]
    expected = [12.5, 7.0, -1000.0] + [None] * 8
    assert values(spark, texts, X.safe_double) == expected


def test_whole_number_or_zero(spark):
    texts = ["22", "22.7", "abc", None, "", "-3.9", "1e30"]
    assert values(spark, texts, X.whole_number_or_zero) == [22, 22, 0, 0, 0, -3, 0]


@pytest.mark.parametrize("missing", ["nan", None])
def test_text_or(spark, missing):
    texts = ["root", None, "", "NA", "null", "N/A", "nano", " "]
    expected = ["root", *[missing] * 5, "nano", " "]
    assert values(spark, texts, lambda c: X.text_or(c, missing)) == expected


def test_round_half_up(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (1.005,), (0.125,), (None,)], "x double")
    assert [r[0] for r in df.select(X.round_half_up("x", 0)).collect()] == [3, -3, 1, 0, None]
    assert [r[0] for r in df.select(X.round_half_up("x", 2)).collect()] == [2.5, -2.5, 1.0, 0.13, None]


def test_change_rules_differ_at_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (5, 0), (3, 2), (0, 4), (1, None)], "a long, p long")
    a, p = F.col("a"), F.col("p")
    from_one = [r[0] for r in df.select(X.change_pct_from_one(a, p)).collect()]
    or_zero = [r[0] for r in df.select(X.change_pct_or_zero(a, p)).collect()]
    assert from_one == [-100.0, 0.0, 400.0, 50.0, -100.0, None]
    assert or_zero == [0.0, 0.0, 0.0, 50.0, -100.0, 0.0]


def test_percent_of_nothing_is_null(spark):
    df = spark.createDataFrame([(1, 0), (1, 4)], "a long, b long")
    assert [r[0] for r in df.select(X.percent("a", "b")).collect()] == [None, 25.0]


def test_absent_counts_sentinels(spark):
    assert values(spark, [None, "None", "Unknown", "x"], lambda c: X.absent(c, "None", "Unknown")) == [
        True, True, True, False,
    ]


def test_calendar(spark):
    days = tuples(calendar(spark, to_day("2024-02-28"), to_day("2024-03-01")))
    assert [str(d[0]) for d in days] == ["2024-02-28", "2024-02-29", "2024-03-01"]
    assert days_between(to_day("2024-02-28"), to_day("2024-03-01")) == 3
    assert tuples(calendar(spark, to_day("2024-03-02"), to_day("2024-03-01"))) == []
