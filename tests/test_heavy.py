"""Largest values by proof and by size classes, overlap by sketches, digests and drifting files against plain plans."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demo import catalogue
from siegelog.operators.heavy import BUCKETS, DailySketches, bucket_counts, largest_values, merged
from siegelog.operators.sketch_sets import SketchStore
from siegelog.operators.threshold import SizeClasses
from siegelog.plans import digests
from siegelog.sources import drift, lake

FIRST = dt.date(2024, 1, 1)


def skewed(seed=2, rows=20_000, values=30_000):
    pick = random.Random(seed)
    out = [(FIRST + dt.timedelta(pick.randrange(30)), f"v{int(values ** pick.random())}", pick.randint(1, 5)) for _ in range(rows)]
    return [*out, (FIRST, None, 9), (FIRST, "", 2)]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(skewed(), "date date, v string, w long").repartition(5).cache()


def plain(rows, column, n, weight=None):
    own = F.count("*") if weight is None else F.sum(weight)
    return [tuple(r) for r in rows.filter(F.col(column).isNotNull()).groupBy(column).agg(own.alias("a")).orderBy(F.desc("a"), column).limit(n).collect()]


@pytest.mark.parametrize("n, weight", [(1, None), (20, None), (20, "w"), (300, "w"), (100_000, None)])
def test_largest_is_the_full_sort(log, n, weight):
    found, proof = largest_values(log, "v", n, weight)
    want = plain(log, "v", n, weight)
    assert [tuple(r) for r in found.collect()] == want
    if n <= 20:  # few buckets were counted, and none of the others could hold a member
        assert proof.counted < 500 and proof.left_out < proof.floor == want[-1][1]


def test_ties_and_flat_data(spark):
    flat = spark.range(3000).selectExpr("concat('k', id) as v")
    found, proof = largest_values(flat, "v", 7)
    assert [tuple(r) for r in found.collect()] == plain(flat, "v", 7) and proof.floor == 1
    assert largest_values(flat.filter("false"), "v", 7)[0].count() == 0


def test_sketches_merge_over_days(spark, log, tmp_path):
    stored = DailySketches(str(tmp_path), ("v",), "w").build(log)
    for a, b in (("2024-01-01", "2024-01-30"), ("2024-01-05", "2024-01-11"), ("2030-01-01", "2030-01-02")):
        part = log.filter(F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date")))
        sketch = {tuple(r) for r in stored.sketch(spark, "v", a, b).collect()}
        assert sketch == {tuple(r) for r in merged(bucket_counts(part, "v", "w")).collect()} and len(sketch) <= BUCKETS
        assert [tuple(r) for r in stored.largest(log, "v", a, b, 15)[0].collect()] == plain(part, "v", 15, "w")


@pytest.mark.parametrize("a, b, n", [(0, 29, 5), (3, 3, 5), (0, 29, 1), (10, 20, 400), (0, 29, 100_000), (40, 50, 3)])
def test_threshold_is_the_full_sort(spark, log, tmp_path, a, b, n):
    daily = log.groupBy("date", F.col("v").alias("ip")).agg(F.sum("w").alias("attacks"))
    stored = SizeClasses(str(tmp_path), "ip").build(daily)
    start, end = FIRST + dt.timedelta(a), FIRST + dt.timedelta(b)
    part = daily.filter(F.col("date").between(F.lit(start), F.lit(end)))
    found, read = stored.largest(spark, start, end, n)
    assert [tuple(r) for r in found.collect()] == plain(part, "ip", n, "attacks")
    assert read.all_rows == part.filter("ip is not null").count() and read.rows <= read.all_rows
    if (a, b, n) == (0, 29, 1):
        assert read.rows < read.all_rows / 10 and read.candidates < 100


def test_overlap_by_sketches(spark, tmp_path):
    pick = random.Random(8)
    rows = [(FIRST + dt.timedelta(k % 10), f"ip{pick.randrange(30_000)}", "AB"[k % 2]) for k in range(60_000)] + [(FIRST, None, "A"), (None, "x", "A")]
    frame = spark.createDataFrame(rows, "date date, ip string, country string")
    middle = FIRST + dt.timedelta(5)
    sets = [{i for d, i, c in rows if i and d and cond(d, c)} for cond in (lambda d, c: c == "A" and d < middle, lambda d, c: d >= middle)]
    want = len(sets[0] & sets[1]), len(sets[0] - sets[1]), len(sets[1] - sets[0]), len(sets[0] | sets[1])
    first, second = (F.col("country") == "A") & (F.col("date") < F.lit(middle)), F.col("date") >= F.lit(middle)
    for lg_k in (16, 10):
        store = SketchStore(str(tmp_path / str(lg_k)), "ip", ("country",), lg_k).build(frame)
        got = store.overlap(spark, first, second).first()
        if lg_k == 16:  # more entries than entities: exact
            assert tuple(got)[:4] == want and got.error == 0
        else:
            assert got.error > 0 and all(abs(g - w) <= got.error for g, w in zip(tuple(got)[:4], want, strict=True))
    assert store.overlap(spark, F.col("country") == "none", second).first().both == 0


def test_digests_name_the_differences(spark):
    pick = random.Random(1)
    rows = [(FIRST + dt.timedelta(k % 20), f"e{pick.randrange(800)}", pick.choice(["x", None, "", "-", "="]), k) for k in range(4000)]
    rows += [rows[5], (None, "e1", "x", 1), (FIRST, None, None, None)]
    other = [r for r in rows if r is not rows[77]]
    other[9] = (*other[9][:3], -1)
    other[11] = (other[11][0], other[11][1], "" if other[11][2] is None else None, other[11][3])
    other += [(None, "e1", "x", 2), rows[100]]
    schema, keys = "date date, ip string, country string, attacks long", ["date", "ip", "country"]
    a, b = (spark.createDataFrame(x, schema).repartition(k) for x, k in ((rows, 3), (other, 7)))
    got = Counter(tuple(r) for r in digests.differing_rows(a, b, keys, ["attacks"]).collect())
    x, y = Counter(rows), Counter(other)
    want = Counter({(*r, "only_first"): n for r, n in (x - y).items()}) + Counter({(*r, "only_second"): n for r, n in (y - x).items()})
    assert got == want and sum(r[3] or 0 for r in rows) != 0
    # totals that agree do not hide a difference, and few leaves are read
    swapped = a.withColumn("attacks", F.when(F.col("attacks") == 10, 20).when(F.col("attacks") == 20, 10).otherwise(F.col("attacks")))
    first, second = (digests.leaf_digests(t, keys, ["attacks"]) for t in (a, swapped))
    assert digests.differing_leaves(first, second).count() == 2
    assert digests.differing_rows(a, swapped, keys, ["attacks"], first, second).count() == 4
    assert digests.differing_rows(a, a.repartition(2), keys, ["attacks"]).count() == 0
    assert {tuple(r) for r in digests.added(first).collect()} != {tuple(r) for r in digests.added(second).collect()}
    assert digests.differing_rows(a.limit(0), a.limit(0), keys, ["attacks"]).count() == 0


def test_types_meet():
    i, n, d, s = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()
    assert drift.wider(i, n) == n and drift.wider(n, d) == d and drift.wider(d, s) == s and drift.wider(i, T.BooleanType()) == s
    assert drift.wider(T.DecimalType(9, 2), T.DecimalType(12, 2)) == T.DecimalType(12, 2) and drift.wider(T.DecimalType(9, 2), n) == d
    assert drift.wider(T.DateType(), T.TimestampNTZType()) == T.TimestampNTZType() and drift.wider(T.DateType(), n) == s
    assert drift.wider(T.NullType(), i) == i
    kinds = [i, n, d, s, T.BooleanType(), T.DateType(), T.TimestampType(), T.ArrayType(i), T.ArrayType(s), T.DecimalType(9, 2)]
    for a in kinds:
        for b in kinds:
            assert drift.wider(a, b) == drift.wider(b, a) and drift.wider(a, drift.wider(a, b)) == drift.wider(a, b)


def test_union_of_drifting_files(spark, tmp_path):
    parts = [
        spark.sql("select 1 as a, array(1) as l, named_struct('x', 1) as s, date'2024-01-02' as t"),
        spark.sql("select 2.5D as A, array('q') as l, named_struct('x', 'u', 'y', 2) as s, timestamp_ntz'2024-01-02 03:04:05' as t"),
        spark.sql("select cast(9007199254740993 as bigint) as a, 'only here' as b"),
    ]
    for k, part in enumerate(parts):
        part.write.parquet(str(tmp_path / str(k)))
    rows, schema = drift.read_drifting(spark, *(str(tmp_path / str(k)) for k in range(3)))
    assert rows.columns == ["a", "l", "s", "t", "b"] and rows.schema["a"].dataType == T.DoubleType() == schema["a"].dataType
    got = sorted(rows.collect(), key=lambda r: r.a)
    assert [r.a for r in got] == [1.0, 2.5, 9007199254740992.0] and [r.l for r in got] == [["1"], ["q"], None]
    assert got[0].s.x == "1" and got[0].s.y is None and got[1].s.y == 2 and got[2].s is None and got[2].b == "only here"
    assert [r.t for r in got] == [dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5), None]


def test_write_checked_scans_once(spark, tmp_path):
    rows = [(dt.datetime(2024, 1 + k % 3, 5), 2024, 1 + k % 3, k) for k in range(90)] + [(None, None, None, k) for k in range(7)]
    schema = T.StructType.fromDDL("datetime timestamp_ntz, year int, month int, k int")
    seen = spark.sparkContext.accumulator(0)

    def count(row):
        seen.add(1)
        return row

    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4).map(count), schema)
    written = lake.write_checked(frame, str(tmp_path / "lake"))
    assert seen.value == 97  # a second scan would count again
    assert (written.rows, written.undated_rows, written.first, written.last) == (97, 7, dt.datetime(2024, 1, 5), dt.datetime(2024, 3, 5))
    stored = lake.read_attacks(spark, written.accepted)
    assert {(r.year, r.month): r["rows"] for r in lake.partition_counts(stored).collect()} == {(2024, m): 30 for m in (1, 2, 3)}
    assert lake.undated(frame).first().undated_rows == written.undated_rows
    assert sorted(r.k for r in spark.read.parquet(written.rejected).collect()) == list(range(7))
    none = lake.write_checked(frame.filter("k < 0"), str(tmp_path / "none"))
    assert none.rows == 0 and none.undated_rows == 0


def test_drifting_files_hold_large_numbers(spark, tmp_path):
    """Users and events beyond a narrow type keep their numbers and the types of the files."""
    ids = [(k, 4 * 20_000 + k % 4) for k in range(8)] + [(2**31 + k, k) for k in range(8)] + [(None, 4)]
    rows = [(i, dt.datetime(2024, 1, 2, 3, 4), u, "click") for i, u in ids]
    schema = T.StructType.fromDDL("event_id long, ts timestamp_ntz, user_id long, event_type string")
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events.parquet"))
    got = catalogue.queries()["union_of_drifting_types"](spark, str(tmp_path)).collect()
    number = lambda i, u: None if i is None else i + (0.5 if u % 4 == 1 else 0.0)
    want = Counter((number(i, u), ("u" if u % 4 == 2 else "") + str(u)) for i, u in ids)
    assert Counter((r.event_id, r.user_id) for r in got) == want
    chosen = {r.column: (r.types, r.chosen, r.filled) for r in catalogue.queries()["drifting_types"](spark, str(tmp_path)).collect()}
    assert chosen["event_id"] == ("bigint,double,int", "double", 16) and chosen["user_id"] == ("bigint,double,smallint,string", "string", 17)
