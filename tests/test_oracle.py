"""Every registered query with SQL against it on the smallest test tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from demo import catalogue
from tests.compare import TESTDATA, connect, differences

SF_DIR = str(TESTDATA / "sf0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_queries_on_logs_have_sql():
    assert set(catalogue.queries()) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, connection, key):
    assert differences(entry.queries()[key](spark, SF_DIR), connection, entry.oracle_sql()[key]) is None


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["date", "country", "attacks"]
    assert rows.count() > 0
