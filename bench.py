"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Three groups of figures, as the workload has three stages:

- ``build_rollups``: the log is enriched and all daily tables are written once;
- ``raw_*``: a query straight from the log, including enrichment and rollup;
- ``serve_*``: the same questions answered from the written daily tables.

Everything runs once to warm up; queries then run ``$BENCH_RUNS`` times and the
median is reported. Results are collected, as a caller would, except for those
of about one row per log row, which are computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from demo import catalogue, mapping
from demo.settings import ASN, COUNTRIES, COUNTRY, END, IP, RANK_METRICS, START, USERNAME
from siegelog.operators import ranking
from siegelog.operators.rollups import Rollups
from siegelog.plans import quality, reports
from siegelog.plans.filters import Filters
from siegelog.plans.series import series
from siegelog.plans.summary import entity_counts, entity_summary
from siegelog.plans.volatility import volatile_series, volatility_summary

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

RAW = (
    "daily_stats",
    "daily_country",
    "daily_ip_username",
    "country_stats",
    "top_ips",
    "country_series",
    "ip_series_country",
    "country_summary",
    "data_quality",
    "ingest_normalise",
)


ROW_LEVEL = ("daily_ip_username", "ingest_normalise")


def served(r: Rollups) -> dict:
    def f(**wanted):
        return Filters.of(START, END, **wanted)

    return {
        "total_series": lambda: series(r, "total", f()),
        "total_series_username": lambda: series(r, "total", f(username=USERNAME)),
        "country_series": lambda: series(r, "country", f()),
        "country_series_asn": lambda: series(r, "country", f(asn=ASN)),
        "ip_series": lambda: series(r, "ip", f()),
        "ip_series_ip": lambda: series(r, "ip", f(ip=IP)),
        "username_series": lambda: series(r, "username", f()),
        "asn_series_countries": lambda: series(r, "asn", f(country=COUNTRIES)),
        "unusual_countries": lambda: volatile_series(r, "country", f()),
        "unusual_country": lambda: volatile_series(r, "country", f(country=COUNTRY)),
        "volatile_ip": lambda: volatility_summary(r, "ip"),
        "country_summary": lambda: entity_summary(r, "country", START, END),
        "asn_summary": lambda: entity_summary(r, "asn", START, END),
        "ip_summary": lambda: entity_summary(r, "ip", START, END),
        "username_summary": lambda: entity_summary(r, "username", START, END),
        "average_rank": lambda: ranking.average_rank(
            entity_summary(r, "country", START, END), RANK_METRICS, "country"
        ),
        "entity_counts": lambda: entity_counts(r, START, END),
        "weekly_trend": lambda: reports.weekly_trend(r.stats),
        "reconcile": lambda: quality.reconcile_all(r),
    }


def collect(df: DataFrame) -> None:
    df.collect()


def discard(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def seconds(action) -> float:
    begin = time.perf_counter()
    action()
    return time.perf_counter() - begin


def median_seconds(query, finish=collect) -> float:
    finish(query())
    return round(statistics.median(seconds(lambda: finish(query())) for _ in range(RUNS)), 4)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("siegelog-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # Call sites of column expressions, kept for error messages, cost more
        # than planning does on queries of this size.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    figures: dict[str, float] = {}
    log = mapping.attacks(spark, SF_DIR)
    Rollups.build(log, tempfile.mkdtemp(prefix="siegelog-bench-"))
    folder = tempfile.mkdtemp(prefix="siegelog-bench-")
    figures["build_rollups"] = round(seconds(lambda: Rollups.build(log, folder)), 4)
    stored = Rollups.read(spark, folder)

    registered = catalogue.queries()
    for key in RAW:
        figures[f"raw_{key}"] = median_seconds(
            lambda: registered[key](spark, SF_DIR), discard if key in ROW_LEVEL else collect
        )
    for key, query in served(stored).items():
        figures[f"serve_{key}"] = median_seconds(query)

    print(
        json.dumps(
            {
                "metric": "total seconds over all queries (median of runs each)",
                "value": round(sum(figures.values()), 3),
                "unit": "sec",
                "queries": figures,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "cpus": int(CPUS),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
