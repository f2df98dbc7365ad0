"""Attack-log analytics as PySpark DataFrame functions.

``sources``    raw logs, address lookup, the partitioned Parquet lake
``functions``  column expressions shared by the plans
``operators``  joins, rollups, top-N, ranking, paging, set comparison
``plans``      series, volatility, summaries, quality checks, reports
``streaming``  incremental rollups over newly arrived files
"""
