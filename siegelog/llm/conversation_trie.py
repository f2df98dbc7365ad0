"""A trie of conversations' common beginnings, found by hashes of blocks of turns.

Conversations are cut into blocks of ``BLOCK`` turns. A block's key is a digest of all
turns up to its end, so conversations are grouped by successive blocks first: one row
for each distinct block, however many conversations run through it. Only blocks that
begin alike and then differ (same turns before them and same first turn) are refined
turn by turn; in all others every turn has the members of the block.

Sums over subtrees go from turns to the ends of blocks inside a block, and from block to
block by doubling the distance, so the rounds grow with the logarithm of the longest
conversation. Nodes are keyed by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siegelog.llm.storage import ship, stored

# Turns in a block.
BLOCK = 4
# Values of `turn` that are sorted in one task; a longer conversation is sorted in parts.
SPAN = 256
# Conversation ids whose text is joined in one row before it is hashed.
IDS = 1 << 16

#: The trie's root, and the digest of a node without conversations that end there.
ROOT = b""
NOTHING = hashlib.sha256(b"").hexdigest()

WORD = r"[^\x20\x09-\x0D]+"


def digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _contents(role: Column, text: Column) -> tuple[Column, Column]:
    """Digest of a turn and the number of words in its text; null is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    own = digest(F.encode(F.concat(F.length(role).cast("string"), F.lit(":")), "UTF-8"), F.encode(role, "UTF-8"), F.encode(text, "UTF-8"))
    return own, F.regexp_count(text, F.lit(WORD)).cast("long")


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv``, ``pos`` (from 1), ``turn_key``, ``words`` of each turn.

    Turns are in the order of ``turn``, null first; equal ones by the role, then by the
    turn's digest. Rows without ``conv_id`` belong to no conversation and are left out.
    A conversation's turns are sorted in parts of ``SPAN`` values.
    """
    key, words = _contents(F.col("role"), F.col("text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        key.alias("turn_key"),
        words.alias("words"),
        F.floor(F.col("turn") / SPAN).alias("part"),
    )
    parts = rows.groupBy("conv", "part").count()
    before = F.sum("count").over(Window.partitionBy("conv").orderBy(F.col("part").asc_nulls_first())) - F.col("count")
    parts = parts.select(F.col("conv").alias("of"), F.col("part").alias("of_part"), before.alias("before"))
    same = (F.col("conv") == F.col("of")) & F.col("part").eqNullSafe(F.col("of_part"))
    own = Window.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), "role", "turn_key")
    placed = rows.join(parts, same).withColumn("pos", (F.col("before") + F.row_number().over(own)).cast("long"))
    return placed.select("conv", "pos", "turn_key", "words")


def rebuilt(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of conversations that begin as the first one of their family does.

    Conversation c takes the first h turns of conversation c - c % ``family`` (all if it
    has fewer, none if it is absent), h = crc32 of the decimal c, modulo ``most``; its own
    turns after its first h follow. Lengths has every conversation, also without turns.
    """
    shared = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    heads = (
        turns.filter((F.col("conv") % family == 0) & (F.col("pos") < most))
        .groupBy(F.col("conv").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "turn_key", "words"))).alias("head"))
    )
    lengths = turns.groupBy("conv").agg(F.max("pos").alias("own")).withColumn("base", F.col("conv") - F.col("conv") % family)
    lengths = lengths.join(heads, "base", "left").withColumn("shared", shared.cast("int"))
    taken = F.least(F.col("shared"), F.coalesce(F.size("head"), F.lit(0))).cast("int")
    lengths = lengths.withColumn("taken", F.when(F.col("head").isNull(), 0).otherwise(taken))
    copies = lengths.filter("taken > 0").select("conv", F.explode(F.slice("head", 1, F.col("taken"))).alias("h"))
    copies = copies.select("conv", "h.pos", "h.turn_key", "h.words")
    shifts = lengths.filter("shared > taken").select("conv", (F.col("shared") - F.col("taken")).cast("long").alias("shift"))
    own = turns.filter(F.col("pos") > shared).join(shifts, "conv", "left")
    own = own.select("conv", (F.col("pos") - F.coalesce("shift", F.lit(0))).alias("pos"), "turn_key", "words")
    total = F.col("taken") + F.greatest(F.col("own") - F.col("shared"), F.lit(0))
    return own.unionByName(copies), lengths.select("conv", total.cast("long").alias("length"))


def _chained(batches) -> Iterator[pa.RecordBatch]:
    """Block keys of conversations whose blocks follow one another; only the last key is held."""
    conv, key = None, ROOT
    for batch in batches:
        parents, keys = [], []
        for c, path in zip(batch.column("conv").to_pylist(), batch.column("content").to_pylist(), strict=True):
            if c != conv:
                conv, key = c, ROOT
            parents.append(key)
            for turn_key in path:
                key = hashlib.md5(key + turn_key).digest()
            keys.append(key)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in ("conv", "block", "content", "words")), pa.array(parents, pa.binary()), pa.array(keys, pa.binary())],
            ["conv", "block", "content", "words", "parent", "key"],
        )


def blocks(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row for each block of each conversation: its turns, the key at its end, the key before it."""
    ship(turns.sparkSession)
    block = F.floor((F.col("pos") - 1) / size).cast("long").alias("block")
    gathered = turns.groupBy("conv", block).agg(F.array_sort(F.collect_list(F.struct("pos", "turn_key", "words"))).alias("turns"))
    gathered = gathered.select("conv", "block", F.col("turns.turn_key").alias("content"), F.col("turns.words").alias("words"))
    ordered = gathered.repartition("conv").sortWithinPartitions("conv", "block")
    return ordered.mapInArrow(_chained, "conv long, block long, content array<binary>, words array<bigint>, parent binary, key binary")


def _prefixes(parent: Column, content: Column) -> Column:
    """Keys of the nodes along a block, in the order of its turns."""
    start = F.array(parent)
    grown = F.aggregate(content, start, lambda path, turn: F.concat(path, F.array(digest(F.element_at(path, -1), turn))))
    return F.slice(grown, 2, F.greatest(F.size(content), F.lit(1)))


def nodes(block_rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row for each node below the root.

    ``node``, ``parent``, ``block_parent`` (the node before the block), ``path`` (the
    nodes of the block down to this one), ``depth``, ``conv``, ``n_convs``, ``words``.
    """
    distinct = block_rows.groupBy("parent", "key").agg(
        F.count("*").alias("n"),
        F.min("conv").alias("conv"),
        F.first("block").alias("block"),
        F.first("content").alias("content"),
        F.first("words").alias("words"),
    )
    distinct = stored(distinct.withColumn("first", F.element_at("content", 1)), "trie-blocks")
    diverging = distinct.groupBy("parent", "first").count().filter("count > 1").select("parent", "first", F.lit(True).alias("differs"))
    flagged = distinct.join(diverging, ["parent", "first"], "left").withColumn("path", _prefixes(F.col("parent"), F.col("content")))
    each = flagged.select(
        F.col("parent").alias("block_parent"), "block", "path", "conv", "n", "differs", F.posexplode("words").alias("at", "words")
    )
    each = each.select(
        F.element_at("path", F.col("at") + 1).alias("node"),
        F.when(F.col("at") > 0, F.element_at("path", F.greatest("at", F.lit(1)))).otherwise(F.col("block_parent")).alias("parent"),
        "block_parent",
        F.slice("path", 1, F.col("at") + 1).alias("path"),
        (F.col("block") * size + F.col("at") + 1).cast("long").alias("depth"),
        "conv",
        F.col("n").alias("n_convs"),
        "words",
        "differs",
    )
    alike = each.filter("differs is null").drop("differs")
    refined = (
        each.filter("differs")
        .groupBy("node", "parent", "block_parent", "path", "depth", "words")
        .agg(F.min("conv").alias("conv"), F.sum("n_convs").alias("n_convs"))
    )
    return alike.unionByName(refined.select(alike.columns))


def _block_sums(each: DataFrame, size: int) -> DataFrame:
    """``node``, ``leaves``, ``saved``: sums over all that lies below the ends of full blocks and the root.

    In round j a node has the sums of the blocks less than 2^j below it and its ancestor
    2^j blocks above; adding what nodes that far below have doubles both.
    """
    own = each.groupBy(F.col("block_parent").alias("node")).agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    above = each.filter(F.col("depth") % size == 0).select("node", F.col("block_parent").alias("up"))
    current = stored(own.join(above, "node", "left"), "trie-sums")
    while not current.filter("up is not null").isEmpty():
        added = current.filter("up is not null").groupBy(F.col("up").alias("node"))
        added = added.agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = current.filter("up is not null").select(F.col("node").alias("up"), F.col("up").alias("up_up"))
        current = current.join(added, "node", "left").join(further, "up", "left")
        current = stored(
            current.select(
                "node",
                (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
                F.col("up_up").alias("up"),
            ),
            "trie-sums",
        )
    return current.drop("up")


def _hashed(batches) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, whose rows follow one another; texts are hashed as they come."""

    def out(node: bytes, state) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    last, state = None, None
    for batch in batches:
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids"), strict=True):
            if node != last:
                if state:
                    yield out(last, state)
                last, state = node, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
    if state:
        yield out(last, state)


def ends(block_rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """``node``, ``ends_sha256`` of nodes at which conversations end.

    Ids are joined to text in parts of ``IDS`` values first; the digest of a node takes
    its parts in order, one after the other.
    """
    last = block_rows.groupBy("conv").agg(F.max_by("key", "block").alias("node"))
    last = last.unionByName(lengths.filter("length = 0").select("conv", F.lit(ROOT).alias("node")))
    part = F.floor(F.col("conv") / IDS).alias("part")
    texts = last.groupBy("node", part).agg(F.array_join(F.transform(F.array_sort(F.collect_set("conv")), lambda x: x.cast("string")), ",").alias("ids"))
    ordered = texts.repartition("node").sortWithinPartitions("node", "part")
    return ordered.select("node", "ids").mapInArrow(_hashed, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, family: int = 20, most: int = 4, size: int = BLOCK) -> DataFrame:
    """One row for each distinct beginning of the rebuilt conversations (``rebuilt``).

    ``node`` is its digest (empty: the root), ``parent_node`` that of the node above.
    ``conv_id`` is the smallest member, ``depth`` the number of turns, ``parent_conv_id``
    the parent's smallest member (root: null), ``n_convs`` counts members, ``n_children``
    children, ``n_leaves`` childless nodes in the subtree, ``saved_tokens`` the words
    that its nodes share (for each node n_convs - 1 times the words of its last text).
    ``ends_sha256`` is the digest of the ids of conversations that end here.

    Null roles and texts are empty; rows without ``conv_id`` are left out; repeated rows
    are turns of their own; a table without conversations has no node. Other columns
    are ignored.
    """
    turns = stored(numbered(conversations), "trie-turns")
    every, lengths = rebuilt(turns, family, most)
    lengths = stored(lengths, "trie-lengths")
    cut = stored(blocks(every, size), "trie-cut")
    each = nodes(cut, size)
    root = lengths.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(
        F.lit(ROOT).alias("node"),
        F.lit(None).cast("binary").alias("parent"),
        F.lit(None).cast("binary").alias("block_parent"),
        F.array(F.lit(ROOT)).alias("path"),
        F.lit(0).cast("long").alias("depth"),
        "conv",
        "n_convs",
        F.lit(0).cast("long").alias("words"),
    )
    each = stored(each.unionByName(root), "trie-nodes")
    children = each.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    valued = each.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    valued = valued.withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    valued = stored(valued.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "trie-valued")
    below = _block_sums(valued.filter("depth > 0"), size)
    # what a node adds to itself and to the nodes above it in its block: its own value and all blocks below it
    parts = valued.select("path", "leaf", "saved").union(
        valued.select("node", "path").join(below, "node").select("path", "leaves", "saved")
    )
    sums = parts.select(F.explode("path").alias("node"), "leaf", "saved").groupBy("node")
    sums = sums.agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    above = valued.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    result = valued.join(sums, "node").join(ends(cut, lengths), "node", "left").join(above, "parent", "left")
    return result.select(
        F.col("conv").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
        "node",
        F.col("parent").alias("parent_node"),
    )
