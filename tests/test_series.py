from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from siegelog.operators.rollups import Rollups
from siegelog.plans import series as S
from siegelog.plans.filters import Filters, route
from tests import data
from tests.data import tuples

ROWS = [
    ("2024-01-01", "1.1.1.1", "A", "N1", "root", 5),
    ("2024-01-01", "1.1.1.1", "B", "N1", "root", 2),
    ("2024-01-03", "1.1.1.1", "A", "N1", "o'brien", 1),
    ("2024-01-01", "2.2.2.2", "B", "N2", "root", 4),
    ("2024-01-02", "3.3.3.3", "C", "N2", "admin", 4),
    ("2024-01-03", "4.4.4.4", None, None, "admin", 9),
]


@pytest.fixture(scope="module")
def r(spark):
    return Rollups.of(data.attacks(spark, ROWS).cache())


def f(start="2024-01-01", end="2024-01-03", **wanted):
    return Filters.of(start, end, **wanted)


def test_filters_split_lists_and_drop_repeats():
    wanted = Filters.of(asn="N1|||N2|||N1", ip=["a", "b", "a"], country="x")
    assert wanted.asn == ("N1", "N2") and wanted.ip == ("a", "b") and wanted.country == ("x",)
    assert wanted.given() == {"asn", "ip", "country"}
    assert (str(wanted.start), str(wanted.end)) == ("2022-11-01", "2023-01-08")


def test_route():
    assert route("asn", ()) == "asn"
    assert route("asn", ("country",)) == "asn"
    assert route("asn", ("ip", "country")) == "ip"
    assert route("asn", ("ip", "username")) == "ip_username"


def test_total(r):
    assert tuples(S.series(r, "total", f())) == [("2024-01-01", 11), ("2024-01-02", 4), ("2024-01-03", 10)]
    assert tuples(S.series(r, "total", f(country="C"))) == [("2024-01-02", 4)]
    assert tuples(S.series(r, "total", f(country="C"), fill=True)) == [
        ("2024-01-01", 0), ("2024-01-02", 4), ("2024-01-03", 0),
    ]
    assert [n for _, n in tuples(S.series(r, "total", f(asn="N1")))] == [7, 0, 1]
    assert [n for _, n in tuples(S.series(r, "total", f(asn="N1", country="B")))] == [2, 0, 0]
    # An address ignores country and network; a username takes every filter.
    assert [n for _, n in tuples(S.series(r, "total", f(ip="1.1.1.1", country="C")))] == [7, 0, 1]
    assert [n for _, n in tuples(S.series(r, "total", f(username="root", country="B")))] == [6, 0, 0]


def test_a_quote_in_a_value_is_only_a_value(r):
    assert [n for _, n in tuples(S.series(r, "total", f(username="o'brien")))] == [0, 0, 1]


def test_top_lines_cover_every_day_and_leave_out_null(r):
    lines = S.series(r, "country", f(), n=2)
    assert sorted(tuples(lines)) == [
        ("2024-01-01", "A", 5), ("2024-01-01", "B", 6),
        ("2024-01-02", "A", 0), ("2024-01-02", "B", 0),
        ("2024-01-03", "A", 1), ("2024-01-03", "B", 0),
    ]
    # All countries: the filled lines add up to the rows with a country.
    everything = S.series(r, "country", f(), n=100)
    assert everything.count() == 3 * 3
    assert everything.agg(F.sum("attacks")).first()[0] == 16


def test_ties_at_the_cut_go_by_name(r):
    assert {c for _, c, _ in tuples(S.series(r, "country", f("2024-01-02"), n=1))} == {"C"}
    ips = S.series(r, "ip", f("2024-01-01", "2024-01-02"), n=2)
    assert {x[1] for x in tuples(ips)} == {"1.1.1.1", "2.2.2.2"}


def test_country_rules(r):
    assert tuples(S.series(r, "country", f(country="C"))) == [("2024-01-02", "C", 4)]
    assert tuples(S.series(r, "country", f(username="root", country="B"))) == [
        ("2024-01-01", "B", 6), ("2024-01-02", "B", 0), ("2024-01-03", "B", 0),
    ]
    assert {x[1] for x in tuples(S.series(r, "country", f(asn="N2")))} == {"B", "C"}
    assert {x[1] for x in tuples(S.series(r, "country", f(username="admin")))} == {"C"}


def test_country_of_an_address(r):
    assert sorted(tuples(S.series(r, "country", f("2023-12-31", ip="1.1.1.1")))) == [
        ("2023-12-31", "A", 0), ("2024-01-01", "A", 5), ("2024-01-01", "B", 2),
        ("2024-01-02", "A", 0), ("2024-01-03", "A", 1),
    ]
    assert tuples(S.series(r, "country", f(ip="9.9.9.9"))) == []


def test_labels(r):
    day = lambda rows: {x[0][-2:]: x[2] for x in rows}
    # The last country by name, or the default on an empty day.
    assert day(tuples(S.series(r, "ip", f(ip="1.1.1.1")))) == {"01": "B", "02": "Unknown", "03": "A"}
    assert day(tuples(S.series(r, "ip", f(ip="4.4.4.4")))) == dict.fromkeys(("01", "02", "03"), "Unknown")
    assert {x[2] for x in tuples(S.series(r, "ip", f(country="B")))} == {"B"}
    mixed = tuples(S.series(r, "ip", f(asn="N2")))
    assert {x[2] for x in mixed if x[3] == 0} == {"Mixed"}
    assert {x[2] for x in tuples(S.series(r, "username", f(ip="1.1.1.1")))} == {"Single IP"}
    assert {x[2] for x in tuples(S.series(r, "username", f(country="A")))} == {"A"}
    assert {x[2] for x in tuples(S.series(r, "username", f()))} == {"Mixed"}


def test_given_networks(r):
    rows = sorted(tuples(S.series(r, "asn", f(asn="N1|||none|||N1"))))
    assert rows == [
        ("2024-01-01", "N1", "B", 7), ("2024-01-01", "none", "Mixed", 0),
        ("2024-01-02", "N1", "Mixed", 0), ("2024-01-02", "none", "Mixed", 0),
        ("2024-01-03", "N1", "A", 1), ("2024-01-03", "none", "Mixed", 0),
    ]
    # All filters apply to networks.
    assert sum(x[3] for x in tuples(S.series(r, "asn", f(asn="N1", ip="1.1.1.1", country="A")))) == 6
    assert sum(x[3] for x in tuples(S.series(r, "asn", f(username="root", country="B")))) == 6


def test_range_outside_the_data(r):
    outside = dict(start="2025-01-01", end="2025-01-02")
    assert tuples(S.series(r, "total", f(**outside, ip="1.1.1.1"))) == [("2025-01-01", 0), ("2025-01-02", 0)]
    assert tuples(S.series(r, "asn", f(**outside, asn="N1"))) == [
        ("2025-01-01", "N1", "Mixed", 0), ("2025-01-02", "N1", "Mixed", 0),
    ]
    for dim in ("total", "country", "ip", "username", "asn"):
        assert tuples(S.series(r, dim, f(**outside))) == []
    assert tuples(S.series(r, "total", f("2024-01-03", "2024-01-01", ip="1.1.1.1"))) == []


def test_unfilled_lines(r):
    rows = tuples(S.series(r, "country", f(asn="N1"), fill=False))
    assert sorted(rows) == [("2024-01-01", "A", 5), ("2024-01-01", "B", 2), ("2024-01-03", "A", 1)]


def test_stored_rows_are_the_filled_grid_without_zeros(r):
    stored = tuples(S.series(r, "country", f(country="A")))
    filled = [x for x in tuples(S.series(r, "country", f(), n=100)) if x[1] == "A" and x[2] > 0]
    assert sorted(stored) == sorted(filled)


def test_totals_and_hidden(r):
    lines = S.series(r, "country", f(), n=10)
    assert tuples(S.series_totals(lines, "country")) == [("A", 6), ("B", 6), ("C", 4)]
    assert tuples(S.series_excluding(lines, "country", ["B"])) == [("A", 5), ("C", 4)]
    assert tuples(S.visible_maximum(lines, "country", ["B"])) == [(5,)]
    assert tuples(S.visible_maximum(lines, "country", [])) == [(6,)]


def test_stored_rollups_answer_alike(r, tmp_path, spark):
    stored = Rollups.build(data.attacks(spark, ROWS), str(tmp_path))
    for dim in ("total", "country", "ip", "username", "asn"):
        for wanted in ({}, {"country": "B"}, {"asn": "N2"}, {"username": "root"}, {"ip": "1.1.1.1"}):
            a, b = S.series(r, dim, f(**wanted)), S.series(stored, dim, f(**wanted))
            assert sorted(tuples(a)) == sorted(tuples(b)), (dim, wanted)


def test_no_cartesian_product(r):
    for dim in ("country", "ip", "username", "asn"):
        plan = S.series(r, dim, f())._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filters_are_values(r):
    assert replace(f(), country=("A",)) == f(country="A")
