"""Queries by name, with the text parameters a dashboard sends."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siegelog.operators.rollups import Rollups, date_range
from siegelog.plans.filters import DEFAULT_END, DEFAULT_START, Filters
from siegelog.plans.series import series
from siegelog.plans.summary import entity_summary
from siegelog.plans.volatility import volatile_series
from siegelog.schema import ENTITY

Params = Mapping[str, str]

# Plural parameters hold several values in one text and win over the singular.
PLURAL = {"country": "countries", "asn": "asns", "ip": "ips", "username": "usernames"}


def filters_from(params: Params, lists: bool = False) -> Filters:
    """Filters of a request; ``lists`` also reads the plural parameters."""
    wanted = {}
    for dim, plural in PLURAL.items():
        if lists and params.get(plural):
            wanted[dim] = params[plural]
        elif params.get(dim):
            wanted[dim] = [params[dim]]
    return Filters.of(
        params.get("start", DEFAULT_START), params.get("end", DEFAULT_END), **wanted
    )


# Rows of an answer that names no limit, where entities are very many.
PAGE = {"ip": 1000, "username": 1000}


def _series(dim: str, lists: bool = False) -> Callable[[Rollups, Params], DataFrame]:
    return lambda rollups, params: series(rollups, dim, filters_from(params, lists))


def _volatile(dim: str, lists: bool = False) -> Callable[[Rollups, Params], DataFrame]:
    return lambda rollups, params: volatile_series(rollups, dim, filters_from(params, lists))


def _summary(dim: str) -> Callable[[Rollups, Params], DataFrame]:
    def query(rollups: Rollups, params: Params) -> DataFrame:
        period = filters_from(params)
        limit = int(params["limit"]) if params.get("limit") else PAGE.get(dim)
        offset = int(params.get("offset", 0))
        return entity_summary(rollups, dim, period.start, period.end, limit=limit, offset=offset)

    return query


def _count(dim: str, name: str) -> Callable[[Rollups, Params], DataFrame]:
    def query(rollups: Rollups, params: Params) -> DataFrame:
        rows = getattr(rollups, dim).filter(filters_from(params).in_range())
        return rows.agg(F.count_distinct(ENTITY[dim]).alias(name))

    return query


ENDPOINTS: dict[str, Callable[[Rollups, Params], DataFrame]] = {
    "date_range": lambda rollups, params: date_range(rollups.stats),
    "total_attacks": _series("total"),
    "country_attacks": _series("country"),
    "unusual_countries": _volatile("country"),
    "ip_attacks": _series("ip"),
    "username_attacks": _series("username"),
    "asn_attacks": _series("asn", lists=True),
    "asn_attacks_volatile": _volatile("asn", lists=True),
    "country_summary": _summary("country"),
    "asn_summary": _summary("asn"),
    "ip_summary": _summary("ip"),
    "username_summary": _summary("username"),
    "country_count": _count("country", "total_countries"),
    "asn_count": _count("asn", "total_asns"),
    "ip_count": _count("ip", "total_ips"),
    "username_count": _count("username", "total_usernames"),
}


def answer(rollups: Rollups, name: str, params: Params) -> DataFrame:
    return ENDPOINTS[name](rollups, params)
