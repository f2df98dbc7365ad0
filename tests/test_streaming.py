from __future__ import annotations

from pyspark.sql import functions as F

from siegelog import schema
from siegelog.operators.rollups import BASE_KEYS, daily_rollup, rollup_duplicates
from siegelog.streaming import incremental
from tests import data
from tests.data import tuples


def lake_rows(spark, rows):
    fact = data.attacks(spark, rows).withColumns(
        {"year": F.year("datetime"), "month": F.month("datetime")}
    )
    missing = {
        f.name: F.lit(None).cast(f.dataType)
        for f in schema.ATTACKS.fields
        if f.name.lower() not in {c.lower() for c in fact.columns}
    }
    return fact.withColumns(missing).select(*[f.name for f in schema.ATTACKS.fields])


def test_new_files_are_added_once(spark, tmp_path):
    lake, target, checkpoint = (str(tmp_path / n) for n in ("lake", "partials", "checkpoint"))
    first = [("2024-01-01", "1", "A", "N", "root", 3), ("2024-02-01", "2", "B", "N", "root", 1)]
    second = [("2024-01-01", "1", "A", "N", "root", 2)]

    def arrive(rows):
        write = lake_rows(spark, rows).write.mode("append").partitionBy("year", "month")
        write.parquet(lake)
        incremental.follow(spark, lake, target, checkpoint).awaitTermination()

    arrive(first)
    arrive(second)
    incremental.follow(spark, lake, target, checkpoint).awaitTermination()  # nothing new

    fact = lake_rows(spark, first + second)
    expected = daily_rollup(fact, BASE_KEYS)
    got = incremental.merged(spark, target)
    assert sorted(tuples(got, *expected.columns)) == sorted(tuples(expected))
    removed = rollup_duplicates(incremental.partials(spark, target), BASE_KEYS)
    assert sorted(tuples(removed, "rows_before", "rows_after")) == [(1, 1), (2, 1)]

    incremental.fold(spark, target, str(tmp_path / "folded"))
    folded = spark.read.parquet(str(tmp_path / "folded"))
    assert sorted(tuples(folded, *expected.columns)) == sorted(tuples(expected))
