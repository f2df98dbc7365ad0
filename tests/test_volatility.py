from __future__ import annotations

import math

import pytest

from siegelog.operators.rollups import Rollups
from siegelog.plans import reports
from siegelog.plans import volatility as V
from siegelog.plans.filters import Filters
from tests import data
from tests.data import tuples


def rows(country, network, *counts, ip=None):
    return [
        (f"2024-01-{day:02d}", ip or f"ip-{country}", country, network, f"user-{country}", n)
        for day, n in enumerate(counts, 1)
        if n
    ]


ROWS = [
    *rows("A", "N1", 2, 4, 8, 0, 2),  # +100, +100, then -75 over the gap
    *rows("B", "N1", 10, 0, 1),  # -90 over the gap
    *rows("C", "N2", 3),  # one day: no change
    *rows("D", "N2", 1, 1, 1),  # changes of 0
    *rows("Unknown", "N3", 1, 9),  # +800, not a country
]


@pytest.fixture(scope="module")
def r(spark):
    return Rollups.of(data.attacks(spark, ROWS).cache())


def test_summary(r):
    assert sorted(tuples(V.volatility_summary(r, "country"))) == [
        ("A", 100.0, "2024-01-02", 4, 2),  # the first of equal days
        ("B", 90.0, "2024-01-03", 1, 10),
        ("D", 0.0, "2024-01-02", 1, 1),
    ]
    assert ("ip-Unknown", 800.0, "2024-01-02", 9, 1) in tuples(V.volatility_summary(r, "ip"))
    networks = {x[0]: x[1] for x in tuples(V.volatility_summary(r, "asn"))}
    assert networks["N1"] == 125.0  # 12, 4, 9, (absent), 2: from 4 to 9
    assert len(tuples(V.volatility_summary(r, "username"))) == 4


def test_country_volatility(r):
    found = {x.country: x for x in V.country_volatility(r).collect()}
    a = found["A"]
    assert (a.days_measured, a.max_change) == (3, 100.0)
    assert math.isclose(a.avg_volatility, (100 + 100 + 75) / 3)
    assert math.isclose(a.volatility_stddev, math.sqrt(((100 - 275 / 3) ** 2 * 2 + (75 - 275 / 3) ** 2) / 2))
    assert found["Unknown"].volatility_stddev is None or found["Unknown"].days_measured == 1
    assert set(x[0] for x in tuples(V.country_volatility(r, 2))) <= {"A", "B", "Unknown"}


def test_series_compares_calendar_days(r):
    got = tuples(V.volatile_series(r, "country", Filters.of("2024-01-01", "2024-01-05"), n=1))
    assert got == [
        ("2024-01-01", "A", 2, 0.0),
        ("2024-01-02", "A", 4, 100.0),
        ("2024-01-03", "A", 8, 100.0),
        ("2024-01-04", "A", 0, -100.0),
        ("2024-01-05", "A", 2, 0.0),  # the day before has no attacks
    ]


def test_series_rules(r):
    period = ("2024-01-01", "2024-01-03")
    chosen = lambda **w: {x[1] for x in tuples(V.volatile_series(r, "country", Filters.of(*period, **w)))}
    assert chosen() == {"A", "B", "D"}
    assert chosen(asn="N1") == {"A", "B"}
    assert chosen(username="user-Unknown") == {"Unknown"}
    assert chosen(country="C") == {"C"}
    assert chosen(asn="N1", country="B") == {"B"}
    assert chosen(ip="ip-B") == {"B"}
    assert chosen(ip="nothing") == set()
    line = tuples(V.volatile_series(r, "country", Filters.of(*period, ip="ip-B", username="x")))
    assert line == [("2024-01-01", "B", 10, 0.0), ("2024-01-02", "B", 0, -100.0), ("2024-01-03", "B", 1, 0.0)]


def test_networks_of_countries(r):
    period = ("2024-01-01", "2024-01-03")
    got = tuples(V.volatile_series(r, "asn", Filters.of(*period, country="A|||D")))
    assert sorted(got) == [
        ("2024-01-01", "N1", 2, 0.0), ("2024-01-01", "N2", 1, 0.0),
        ("2024-01-02", "N1", 4, 100.0), ("2024-01-02", "N2", 1, 0.0),
        ("2024-01-03", "N1", 8, 100.0), ("2024-01-03", "N2", 1, 0.0),
    ]
    given = tuples(V.volatile_series(r, "asn", Filters.of(*period, asn="N1", country="A")))
    assert [x[2] for x in given] == [2, 4, 8]


def test_volume_and_volatility(r):
    period = Filters.of("2024-01-01", "2024-01-05")
    # By volume A and B; by change Unknown and A.
    got = dict(tuples(reports.volume_vs_volatility(r, "country", period, n=2)))
    assert got == {"A": "both", "B": "only_volume", "Unknown": "only_volatility"}
