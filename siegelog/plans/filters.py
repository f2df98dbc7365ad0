"""Query filters, predicates and the choice of the rollup that serves them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siegelog.functions.dates import to_day
from siegelog.schema import ENTITY

LIST_SEPARATOR = "|||"

# The range used when a query names none.
DEFAULT_START = "2022-11-01"
DEFAULT_END = "2023-01-08"

Values = str | Iterable[str] | None


def _values(given: Values) -> tuple[str, ...]:
    """A value, several values or a text list, without repeats, in given order."""
    if given is None:
        return ()
    parts = given.split(LIST_SEPARATOR) if isinstance(given, str) else list(given)
    return tuple(dict.fromkeys(parts))


@dataclass(frozen=True)
class Filters:
    """A closed date range and the wanted values per dimension (empty: all)."""

    start: dt.date
    end: dt.date
    country: tuple[str, ...] = ()
    asn: tuple[str, ...] = ()
    ip: tuple[str, ...] = ()
    username: tuple[str, ...] = ()

    @classmethod
    def of(
        cls,
        start: str | dt.date = DEFAULT_START,
        end: str | dt.date = DEFAULT_END,
        country: Values = None,
        asn: Values = None,
        ip: Values = None,
        username: Values = None,
    ) -> Filters:
        return cls(
            to_day(start), to_day(end), _values(country), _values(asn), _values(ip), _values(username)
        )

    def given(self) -> frozenset[str]:
        return frozenset(dim for dim in ENTITY if getattr(self, dim))

    def in_range(self, date: str = "date") -> Column:
        return F.col(date).between(F.lit(self.start), F.lit(self.end))

    def matches(self, dims: Iterable[str]) -> Column:
        """Conjunction of the filters on ``dims``; true when none is set."""
        tests = []
        for dim in dims:
            values = getattr(self, dim)
            if len(values) == 1:
                tests.append(F.col(ENTITY[dim]) == F.lit(values[0]))
            elif values:
                tests.append(F.col(ENTITY[dim]).isin(*values))
        return reduce(and_, tests, F.lit(True))


def route(dim: str, dims: Iterable[str]) -> str:
    """The coarsest rollup that has ``dim`` and the filtered ``dims``."""
    wanted = set(dims)
    if "username" in wanted:
        return "ip_username"
    return "ip" if "ip" in wanted else dim


def rows_of(table: DataFrame, filters: Filters, dims: Iterable[str]) -> DataFrame:
    return table.filter(filters.in_range() & filters.matches(dims))
