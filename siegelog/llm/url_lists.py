"""URL filters by a temporal list join, in DataFrame functions only.

A list is a log of dated changes: from a time on, a pattern is in a category or no
longer. ``intervals`` turns them into validity intervals, and ``evaluated`` joins every
capture of a URL with the entries that were active when it was fetched. A pattern
is a host, a domain above it, or a host with leading parts of the path.

The as-of join is an equality join on (pattern, span of time) with the interval as a
filter. The spans split a host that holds a large part of all captures, and what is
left of skew is for Spark's skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN_DAYS = 30


def host_of(url: Column) -> Column:
    """Lower-cased host without user and port; empty if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))


def patterns_of(url: Column) -> Column:
    """All patterns that cover a URL: its domains, and its host with the first parts of the path."""
    host = host_of(url)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda k: F.concat_ws("/", host, F.when(k > 0, F.array_join(F.slice(parts, F.lit(1), k), "/")))
    )
    return F.when(host != "", F.array_distinct(F.concat(domains, prefixes))).otherwise(F.array().cast("array<string>"))


def intervals(changes: DataFrame) -> DataFrame:
    """(pattern, category, since, until) from (pattern, category, active, at): until is exclusive, null if still active.

    Of changes of an entry at one time, ``active`` wins. Changes with a null in any
    column are ignored; patterns are compared in lower case.
    """
    clean = changes.select(F.lower("pattern").alias("pattern"), "category", "active", "at").dropna()
    states = clean.groupBy("pattern", "category", "at").agg(F.max("active").alias("active"))
    entry = Window.partitionBy("pattern", "category").orderBy("at")
    return (
        states.withColumn("until", F.lead("at").over(entry))
        .filter("active")
        .select("pattern", "category", F.col("at").alias("since"), "until")
    )


def _span(at: Column) -> Column:
    return F.floor(F.unix_date(F.to_date(at)) / SPAN_DAYS).cast("long")


def evaluated(captures: DataFrame, changes: DataFrame, url_column: str = "url", time_column: str = "fetched") -> DataFrame:
    """``captures`` with ``n_active``, the entries active at fetch time, and ``categories``, theirs in order and joined by a comma.

    A capture without URL, host or time meets no entry: 0 and an empty text. Repeated
    rows are evaluated each. Columns of ``captures`` with those names are replaced.
    """
    columns = [c for c in captures.columns if c.lower() not in ("n_active", "categories")]
    own = captures.select(F.struct("*").alias("_row"), F.col(url_column).alias("_of_url"), F.col(time_column).alias("_of_time"))
    asked = own.select(F.col("_of_url").alias("_url"), F.col("_of_time").alias("_at")).distinct()
    keys = asked.withColumn("pattern", F.explode(patterns_of(F.col("_url")))).withColumn("_span", _span(F.col("_at")))
    # Open intervals reach up to the last capture, and none begins before the first.
    range_ = own.agg(F.min("_of_time").alias("_first"), F.max("_of_time").alias("_last"))
    listed = (
        intervals(changes)
        .join(F.broadcast(range_), F.col("since") <= F.col("_last"))  # one row
        .withColumn("_from", _span(F.greatest("since", "_first")))
        .withColumn("_to", _span(F.least(F.coalesce("until", "_last"), F.col("_last"))))
        .filter("_from <= _to")
        .select("pattern", "category", "since", "until", F.explode(F.sequence("_from", "_to")).alias("_span"))
    )
    active = (F.col("since") <= F.col("_at")) & (F.col("until").isNull() | (F.col("_at") < F.col("until")))
    met = keys.join(listed, ["pattern", "_span"]).filter(active)
    found = met.groupBy("_url", "_at").agg(
        F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories")
    )
    same = (F.col("_of_url") == F.col("_url")) & (F.col("_of_time") == F.col("_at"))
    return own.join(found, same, "left").select(
        *[F.col("_row")[c].alias(c) for c in columns],
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("categories", F.lit("")).alias("categories"),
    )
