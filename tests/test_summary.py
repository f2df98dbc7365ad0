from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict
from statistics import mode

import pytest

from siegelog.operators import ranking
from siegelog.operators.rollups import Rollups
from siegelog.plans import summary
from tests import data
from tests.data import tuples

START, END = dt.date(2024, 1, 3), dt.date(2024, 1, 12)


def half_up(value: float, digits: int) -> float:
    scale = 10.0**digits
    size = int(abs(value) * scale + 0.5) / scale
    return size if value >= 0 else -size


def change(value, previous):
    return (value - 1.0) * 100 if previous == 0 else (value - previous) / previous * 100.0


def brute_force(days: dict[dt.date, int], calendar: bool, start=START, end=END):
    """Metrics of one entity from its day counts, by walking the days."""
    inside = {d: n for d, n in days.items() if start <= d <= end}
    if not inside:
        return None
    length = (end - start).days + 1
    if calendar:
        walked = [inside.get(start + dt.timedelta(i), 0) for i in range(length)]
    else:
        walked = [inside[d] for d in sorted(inside)]
    steps = list(zip(walked[1:], walked))
    week = end - dt.timedelta(6)
    recent = inside if calendar else days
    return (
        sum(inside.values()),
        half_up(sum(inside.values()) / len(inside), 2),
        str(min(inside)),
        str(max(inside)),
        max(inside.values()),
        max((a - p for a, p in steps), default=0),
        half_up(max((change(a, p) for a, p in steps), default=0.0), 2),
        half_up(100.0 * len(inside) / length, 1),
        sum(n for d, n in recent.items() if week <= d <= end),
        len(inside),
    )


METRICS = (
    "total_attacks", "avg_daily", "first_seen", "last_seen", "max_daily", "max_absolute_change",
    "max_pct_change", "persistence_pct", "recent_attacks", "active_days",
)


def random_rows(seed: int, entities: int):
    """Sparse random series around the period, some of them of a single day."""
    pick = random.Random(seed)
    rows = []
    for e in range(entities):
        density = pick.choice([0.05, 0.2, 0.5, 0.9])
        for offset in range(-3, 14):
            if pick.random() < density:
                day = START + dt.timedelta(offset)
                rows.append((str(day), f"ip{e}", f"c{e}", f"n{e}", f"u{e}", pick.choice([1, 1, 2, 7])))
    return rows


@pytest.fixture(scope="module")
def many(spark):
    rows = random_rows(1, 300)
    return rows, Rollups.of(data.attacks(spark, rows).cache())


@pytest.mark.parametrize("dim", ["country", "asn", "ip", "username"])
@pytest.mark.parametrize("end", [END, START + dt.timedelta(3)])
def test_against_walking_the_days(many, dim, end):
    rows, r = many
    column = {"ip": 1, "country": 2, "asn": 3, "username": 4}[dim]
    days = defaultdict(lambda: defaultdict(int))
    for row in rows:
        days[row[column]][dt.date.fromisoformat(row[0])] += row[5]
    expected = {}
    for entity, counts in days.items():
        metrics = brute_force(counts, dim in summary.ON_CALENDAR, end=end)
        if metrics is not None:
            expected[entity] = metrics
    found = summary.entity_summary(r, dim, START, end, limit=None).collect()
    name = summary.ENTITY[dim]
    assert {x[name]: tuple(x[m] for m in METRICS) for x in found} == expected


def test_order_and_pages(many):
    _, r = many
    key = lambda x: (-x.total_attacks, x.ip)
    everything = summary.entity_summary(r, "ip", START, END, limit=None).collect()
    assert everything == sorted(everything, key=key)
    page = summary.entity_summary(r, "ip", START, END, limit=7, offset=5).collect()
    assert page == everything[5:12]
    assert len(summary.entity_summary(r, "country", START, END, limit=3).collect()) == 3


def test_deep_pages(many, monkeypatch):
    """A page beyond the head of the sort is cut from positions."""
    _, r = many
    everything = summary.entity_summary(r, "ip", START, END, limit=None).collect()
    monkeypatch.setattr(ranking, "HEAD_ROWS", 10)
    page = summary.entity_summary(r, "ip", START, END, limit=20, offset=100).collect()
    assert page == everything[100:120]
    assert summary.entity_summary(r, "ip", START, END, limit=None, offset=150).collect() == everything[150:]


def test_labels_of_addresses_and_usernames(spark):
    rows = [
        ("2024-01-03", "x", "B", "N2", "u", 9),
        ("2024-01-04", "x", "A", "N1", "u", 1),
        ("2024-01-05", "x", "A", "N2", "u", 1),
        ("2024-01-06", "x", "B", None, "u", 1),
        ("2024-01-03", "y", None, None, "v", 1),
    ]
    r = data.rollups(spark, rows)
    got = tuples(summary.entity_summary(r, "ip", START, END), "ip", "country", "asn_name")
    # Two days each for A and B: the smaller name.
    assert got == [("x", "A", "N2"), ("y", None, None)]
    assert mode(["N2", "N1", "N2"]) == "N2"
    users = tuples(summary.entity_summary(r, "username", START, END), "username", "countries")
    assert users == [("u", 2)]
    networks = tuples(summary.entity_summary(r, "asn", START, END), "asn_name", "countries")
    assert sorted(networks) == [("N1", 1), ("N2", 2)]


def test_one_day_and_unknown(spark):
    rows = [("2024-01-03", "x", "A", "N", "u", 4), ("2024-01-03", "y", "Unknown", "N", "u", 4)]
    r = data.rollups(spark, rows)
    got = summary.entity_summary(r, "country", "2024-01-03", "2024-01-03").collect()
    assert [(x.country, x.max_absolute_change, x.max_pct_change) for x in got] == [("A", 0, 0.0)]
    ip = summary.entity_summary(r, "ip", START, END, total_days=69).first()
    assert (ip.persistence_pct, ip.max_absolute_change) == (1.4, 0)


def test_counts(many):
    rows, r = many
    inside = [x for x in rows if str(START) <= x[0] <= str(END)]
    got = dict(tuples(summary.entity_counts(r, START, END)))
    assert got == {
        d: len({x[i] for x in inside}) for d, i in (("ip", 1), ("country", 2), ("asn", 3), ("username", 4))
    }
    near = dict(tuples(summary.approximate_entity_counts(r, START, END)))
    assert all(abs(near[d] - n) <= 0.1 * n for d, n in got.items())


def test_partners(spark):
    rows = [("2024-01-03", "x", c, n, "u", 1) for c, n in (("A", "N1"), ("B", "N1"), (None, None))]
    r = data.rollups(spark, rows)
    assert tuples(summary.distinct_partners(r.ip, "ip", "country", START, END)) == [("x", 2)]
    assert tuples(summary.distinct_partners(r.asn, "asn_name", "country", START, END)) == [("N1", 2)]
