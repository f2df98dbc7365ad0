"""Row comparison of a Spark query and its SQL on DuckDB."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TESTDATA = Path("/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def differences(spark_df: DataFrame, connection, sql: str) -> str | None:
    """None when both give the same column names, types and rows."""
    our_types = {name: TYPES.get(kind, kind) for name, kind in spark_df.dtypes}
    described = connection.execute("describe " + sql).fetchall()
    their_types = {row[0]: row[1] for row in described}
    if our_types != their_types:
        return f"types {our_types} against {their_types}"
    columns, ours = _sorted_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    relation = connection.execute(sql)
    names = [d[0] for d in relation.description]
    their_columns, theirs = _sorted_rows(names, relation.fetchall())
    if columns != their_columns:
        return f"columns {columns} against {their_columns}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for mine, other in zip(ours, theirs):
        if mine != other or [type(v) for v in mine] != [type(v) for v in other]:
            return f"{columns}: {mine} against {other}"
    return None
