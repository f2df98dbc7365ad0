"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions only.

The tree is domain, language, source; each node has a weight among its siblings. The
budget of tokens goes down the tree: siblings share their parent's budget by weight,
none beyond what its subtree holds (its tokens times ``max_epochs``). What one cannot
take goes to its siblings by weight, and only what all siblings together cannot
take to the parent's siblings. Each level is a window over siblings: sorted by
capacity / weight, those before the water level are full.

A leaf then reads its documents in epochs, each in an order seeded by the epoch, up to its
budget: whole epochs, and of the last one a prefix of tokens. The key where the prefix
ends is found on a table of ids and token counts: sums over buckets of the order name
one bucket of each leaf, and only that one is sorted. Each document is then compared
with its leaf's key where it lies, so no text is shuffled or sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siegelog.llm.storage import stored

# Hexadecimal digits of the seeded order that name a bucket.
BUCKET_DIGITS = 3
# So many leaves are broadcast; the budgets of more are joined.
BROADCAST_LEAVES = 100_000
_NONE = "(none)"


def tokens_in(text: Column) -> Column:
    """Runs of other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _filled(children: DataFrame) -> DataFrame:
    """``budget`` for rows with parent, parent_budget, weight and capacity: the shares of siblings, none beyond its capacity."""
    rows = children.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")))
    siblings = Window.partitionBy("parent")
    order = siblings.orderBy(F.col("ratio").asc_nulls_last(), "path")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))
    weights = F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", F.when(F.col("weight") > 0, left / weights)).withColumn("place", F.row_number().over(order))
    full = F.col("ratio") <= F.col("level")
    rows = rows.withColumn("full", F.coalesce(full, F.lit(False)))
    first = F.min(F.when(~F.col("full") & (F.col("weight") > 0), F.struct("place", "level"))).over(siblings)
    return rows.withColumn("water", first["level"]).withColumn(
        "budget", F.when(F.col("weight") <= 0, 0.0).when(F.col("full"), F.col("capacity")).otherwise(F.col("weight") * F.col("water"))
    )


def budgets(leaves: DataFrame, levels: list[str], share: float, weights: dict[str, float]) -> DataFrame:
    """Leaves with their ``budget``: in all ``share`` (at most 1) of their capacities.

    ``leaves`` has the level columns (never null) and ``capacity``.
    ``weights`` are by path (``"crawl/en/src0"``); other nodes weigh 1.
    """
    paths = [F.concat_ws("/", *levels[: k + 1]) for k in range(len(levels))]
    nodes = leaves.select(*levels, F.col("capacity").cast("double").alias("capacity"))
    above = nodes.agg((F.sum("capacity") * float(share)).alias("parent_budget")).withColumn("parent", F.lit(""))
    for path, parent in zip(paths, [F.lit(""), *paths], strict=False):
        weight = F.lit(1.0)
        if weights:
            pairs = [F.lit(x) for kv in sorted(weights.items()) for x in (kv[0], float(kv[1]))]
            weight = F.coalesce(F.create_map(*pairs)[F.col("path")], F.lit(1.0))
        children = nodes.groupBy(parent.alias("parent"), path.alias("path")).agg(F.sum("capacity").alias("capacity"))
        above = _filled(children.withColumn("weight", weight).join(above, "parent")).select(
            F.col("path").alias("parent"), F.col("budget").alias("parent_budget")
        )
    return nodes.withColumn("leaf", paths[-1]).join(
        above.select(F.col("parent").alias("leaf"), F.col("parent_budget").alias("budget")), "leaf"
    )


def mixed(
    documents: DataFrame,
    share: float,
    weights: dict[str, float],
    domain: Column,
    seed: str = "mix",
    max_epochs: int = 4,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``documents`` once for each epoch that reads them, with ``leaf``, ``epoch``, ``tokens`` and ``tokens_taken``.

    ``share`` is the number of tokens to take, as a part of those there are; at most
    ``max_epochs``. The last document of a leaf may be taken in part (its first ``tokens_taken``
    tokens). Nulls in domain, lang or source are a value of their own; documents
    without tokens, also those without text, are never read. Repeated rows
    are read each. Columns of ``documents`` with the names above are replaced.
    """
    levels = ["_domain", "_lang", "_source"]
    columns = [c for c in documents.columns if c.lower() not in ("leaf", "epoch", "tokens", "tokens_taken")]
    rows = documents.select(
        F.struct("*").alias("_row"),
        F.coalesce(domain.cast("string"), F.lit(_NONE)).alias("_domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit(_NONE)).alias("_lang"),
        F.coalesce(F.col("source").cast("string"), F.lit(_NONE)).alias("_source"),
        F.col(id_column).alias("_id"),
        tokens_in(F.col(text_column)).alias("_tokens"),
        F.xxhash64(text_column).alias("_text"),
    ).filter("_tokens > 0")
    counted = stored(rows.select(*levels, "_id", "_tokens"), "tokens")
    held = stored(counted.groupBy(*levels).agg(F.sum("_tokens").alias("held")), "leaves")
    plan = budgets(held.withColumn("capacity", F.col("held") * max_epochs), levels, share / max_epochs, weights)
    plan = plan.withColumn("held", F.col("capacity") / max_epochs)
    plan = plan.select(
        *levels,
        F.col("leaf").alias("_leaf"),
        F.floor(F.col("budget") / F.col("held")).cast("int").alias("_whole"),
        F.floor(F.col("budget") - F.floor(F.col("budget") / F.col("held")) * F.col("held")).cast("long").alias("_rest"),
    )
    few = held.count() <= BROADCAST_LEAVES

    def keyed(part: DataFrame, leaves: DataFrame) -> DataFrame:
        """With the order of the last epoch, which is the only one that may end early."""
        key = F.md5(F.concat_ws("|", F.lit(seed), F.col("_whole").cast("string"), F.col("_id").cast("string")))
        return part.join(F.broadcast(leaves) if few else leaves, levels).withColumn("_key", key)

    ends = stored(_ends(keyed(counted, plan)), "ends")
    rows = keyed(rows, plan.join(ends, "_leaf", "left"))
    # A leaf without an end reads the last epoch whole.
    part = (
        F.when(F.col("_end").isNull() | (F.col("_key") < F.col("_end")), F.col("_tokens"))
        .when(F.col("_key") == F.col("_end"), F.col("_rest") - F.col("_start"))
        .otherwise(F.lit(0).cast("long"))
    )
    if ends.filter("_rows > 1").isEmpty():
        rows = rows.withColumn("_part", part)
    else:  # rows that share the id at which a leaf ends, by length and text
        tie = F.coalesce(F.col("_key") == F.col("_end"), F.lit(False))
        order = Window.partitionBy("_leaf").orderBy("_tokens", "_text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = F.col("_start") + F.sum("_tokens").over(order) - F.col("_tokens")
        tied = rows.filter(tie).withColumn("_part", F.least(F.col("_tokens"), F.col("_rest") - before))
        rows = rows.filter(~tie).withColumn("_part", part).unionByName(tied)
    epochs = F.transform(
        F.sequence(F.lit(0), F.col("_whole")), lambda e: F.struct(e.alias("e"), F.when(e < F.col("_whole"), F.col("_tokens")).otherwise(F.col("_part")).alias("n"))
    )
    rows = rows.withColumn("_read", F.explode(F.filter(epochs, lambda x: x["n"] > 0)))
    return rows.select(
        *[F.col("_row")[c].alias(c) for c in columns],
        F.col("_leaf").alias("leaf"),
        F.col("_read.e").alias("epoch"),
        F.col("_tokens").alias("tokens"),
        F.col("_read.n").alias("tokens_taken"),
    )


def _ends(rows: DataFrame) -> DataFrame:
    """Of each leaf the key ``_end`` in which its ``_rest`` of tokens ends, the tokens before it and the rows that share it."""

    def first_over(sums: DataFrame, by: str) -> DataFrame:
        before = Window.partitionBy("_leaf").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_start", F.col("_from") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        return sums.filter("_start <= _rest and _rest < _start + n")

    rows = rows.withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    sums = rows.groupBy("_leaf", "_rest", "_bucket").agg(F.sum("_tokens").alias("n")).withColumn("_from", F.lit(0).cast("long"))
    buckets = first_over(sums, "_bucket").select("_leaf", "_bucket", F.col("_start").alias("_from"))
    keys = (
        rows.join(buckets, ["_leaf", "_bucket"])
        .groupBy("_leaf", "_rest", "_from", F.col("_key").alias("_end"))
        .agg(F.sum("_tokens").alias("n"), F.count("*").alias("_rows"))
    )
    return first_over(keys, "_end").select("_leaf", "_end", "_start", "_rows")
