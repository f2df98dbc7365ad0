"""Connected components of large graphs, kept in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siegelog.llm.storage import stored


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component``: the smallest node that ``edges`` (long columns a, b) reach.

    Only nodes with an edge appear. Alternating star contraction: each node points
    its larger neighbours to its smallest one, then itself and its smaller
    neighbours, until all point to a root. The rounds grow with the logarithm of
    the graph, no neighbourhood is gathered (minima are aggregated before the
    shuffle), and each round is a stored table.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    current = stored(edges.distinct(), "edges")
    before = None
    while True:
        both = current.union(current.select("v", "u"))
        smallest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(smallest, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the smallest neighbour itself is kept by its own larger one
        own = smallest.filter("m < u").select("u", F.col("m").alias("v"))
        large = stored(large.union(own).distinct(), "large-star")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = smallest.select("u", F.col("m").alias("v"))
        current = stored(small.union(own).distinct(), "small-star")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                current.select(F.col("v"), F.col("v")).distinct()
            )
        before = state
