"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A document descends from the root through region and rack to a shard. At each
level every child draws ``-ln(u) / weight``, u a hash of the id and the child's
place, and the smallest draw wins, so a child gets its share of the weight.
Draws don't depend on other children: when weights change, documents only move
into subtrees that grew or out of such that shrank.

A new shard joins as a region of its own (``grown``). All that moves is what its
draw wins at the root, so it takes documents only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siegelog.llm.storage import stored


@dataclass(frozen=True)
class Tree:
    """Weights of the shards of each rack of each region; shards are numbered in this order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @staticmethod
    def even(shards: int, shards_in_rack: int = 2, racks_in_region: int = 2) -> Tree:
        """Shards of weight 1, filled rack by rack."""
        racks = [tuple(1.0 for _ in range(k, min(k + shards_in_rack, shards))) for k in range(0, shards, shards_in_rack)]
        return Tree(tuple(tuple(racks[k : k + racks_in_region]) for k in range(0, len(racks), racks_in_region)))

    def grown(self, weight: float = 1.0) -> Tree:
        return Tree((*self.regions, ((weight,),)))

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def shard_of(self, key: Column) -> Column:
        """The shard of each value of ``key``; nulls share one."""
        region = _drawn(key, "", [sum(map(sum, r)) for r in self.regions])
        first, out = 0, F.lit(None).cast("int")
        for r, racks in enumerate(self.regions):
            rack = _drawn(key, f"{r}", [sum(x) for x in racks])
            inside = F.lit(None).cast("int")
            for k, weights in enumerate(racks):
                inside = F.when(rack == k, _drawn(key, f"{r}/{k}", list(weights)) + first).otherwise(inside)
                first += len(weights)
            out = F.when(region == r, inside).otherwise(out)
        return out


def _drawn(key: Column, place: str, weights: list[float]) -> Column:
    """The child with the smallest draw; of equal ones the first."""
    if len(weights) == 1:
        return F.lit(0)
    draws = []
    for child, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{place}/{child}")), 11)
        u = (bits + 0.5) / float(1 << 53)
        draws.append(F.struct((-F.log(u) / weight).alias("draw"), F.lit(child).alias("child")))
    return F.array_min(F.array(*draws))["child"]


def sharded(documents: DataFrame, tree: Tree, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` of each row.

    The law is ``key``: the id and the tree decide. ``size`` is the text's UTF-8 bytes plus
    1 (a null text has none), ``slot`` numbers a shard's rows from 0 without gaps, and
    ``grown_shard`` is the shard after one more has joined. Rows that share an id, also a null
    one, share a shard and have slots of their own. Other columns don't matter.
    """
    key, body = F.col(id_column).cast("long"), F.coalesce(F.col(text_column).cast("binary"), F.lit(b""))
    rows = documents.select(
        key.alias("id"),
        (F.length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        tree.shard_of(key).alias("shard"),
        tree.grown().shard_of(key).alias("grown_shard"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Places in the input are written down once, so that the numbers don't depend on how tasks are run again.
    rows = stored(rows, "shards")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "part")
        .agg(F.count("*").alias("n"))
        .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("shard", "part").orderBy("row")
    return rows.join(starts, ["shard", "part"]).select(
        F.col("id").alias(id_column),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("start") + F.row_number().over(inside) - 1).alias("slot"),
        "grown_shard",
    )
