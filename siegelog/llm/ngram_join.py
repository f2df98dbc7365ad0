"""Similarity join on word n-grams: exact Jaccard by partitions of the universe.

Method. The sets are dealt into size bands. In a band with sets of at most U
shingles, a hash deals the shingles (the universe) into m segments, the same for
all sets, and a set's segment becomes one signature: a hash of its content. Two
sets that link differ in at most H shingles, so

- *subsets of segments*: of m > H segments at least m - H agree. Signatures are
  ordered by how many sets hold them; the H + 1 rarest of both sets then share
  one. Common and empty segments are never looked at, and a set with more than H
  signatures of its own cannot link at all.
- *one-deletion neighbourhoods*: with (H + 1) / 2 segments, one of them differs
  in one shingle at most. The index then also holds each segment without each
  one of its shingles.

Which of the two a band gets is decided by estimated cost (``allocate``): rows in
the index against expected chance meetings. A set is indexed in its own band, and
in the next lower one if a smaller partner may be there. Sets that meet are
compared shingle by shingle.

Equal sets are one class from the start. Sets that meet, directly or through others,
form a family; families are small but for groups of near copies. A family is
compared in blocks of bounded size, two blocks to a task, by a product of incidence
matrices. A task returns a spanning forest of the links it found and the number of
links of each class, so no plan node makes a row for each pair, and no family is
gathered in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siegelog.llm.components import components
from siegelog.llm.key_filter import key_bitmap, with_flag
from siegelog.llm.storage import ship, stored
from siegelog.llm.wordhash import mix, text_batches, windows, words

# A band's largest set is at most so many times its smallest.
BAND = 1.5
# Segments beyond the H + 1 that must be indexed: the most common ones are left out.
SLACK = 0.15
# For the cost: chance that a shingle of one set is also in an unrelated one.
COMMON = 0.05
# Rows of the index in a shuffle partition.
PARTITION_ROWS = 1_000_000
# A block of a family has about so many shingles, and sets, at most.
BLOCK_SHINGLES = 250_000
BLOCK_SETS = 1000
# Shingles that a step of the incidence product takes.
COLUMNS = 2048
# Sets counted in a bucket; the order of signatures is by this count.
COUNTED = 1000


@dataclass(frozen=True)
class Similarity:
    """Jaccard of at least ``part / whole``."""

    part: int = 80
    whole: int = 100

    def partner(self, n: int) -> int:
        """Largest size of a partner of a set of n."""
        return n * self.whole // self.part

    def differ(self, a: int, b: int) -> int:
        """Shingles in one of two linked sets of these sizes but not in both, at most."""
        return (a + b) * (self.whole - self.part) // (self.whole + self.part)

    def holds(self, both: int, a: int, b: int) -> bool:
        return self.whole * both >= self.part * (a + b - both)


def band_limits(until: int) -> list[tuple[int, int]]:
    """(smallest, largest) size of each band, up to one that holds ``until``."""
    out = [(1, 1)]
    while out[-1][1] < until:
        low = out[-1][1] + 1
        out.append((low, max(low, math.floor(low * BAND))))
    return out


def band_of(n: int) -> int:
    return len(band_limits(n)) - 1


@dataclass(frozen=True)
class Allocation:
    """How a band is indexed."""

    segments: int
    deletions: bool


def allocate(low: int, high: int, sets: int, like: Similarity) -> Allocation:
    """The cheaper way for a band with so many sets: index rows plus expected chance meetings, per set."""
    need = like.differ(high, like.partner(high)) + 1
    n = (low + high) / 2
    exact = need if need == 1 else need + max(1, math.ceil(SLACK * need))
    halved = math.ceil(need / 2)

    def empty(m: int) -> float:
        return m * (1 - 1 / m) ** n

    chance = max(0.0, empty(exact) - (exact - need)) + need * COMMON ** (n / exact)
    chance_halved = empty(halved) + halved * COMMON ** max(0.0, n / halved - 1)
    if need > 1 and halved + n + sets * chance_halved < exact + sets * chance:
        return Allocation(halved, True)
    return Allocation(exact, False)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets one after the other, each in order, and where each begins."""
    w = words(texts)
    hashes = w.hashes(lower=True)
    shingles, at = windows(hashes, w.first, size)
    owner = w.text_of[at]
    counts = np.diff(w.first)
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):  # the whole sequence as one shingle; its length tells it from a window
        whole = np.empty(len(few), np.uint64)
        for k, d in enumerate(few):
            value = np.uint64(counts[d])
            for h in hashes[w.first[d] : w.first[d + 1]]:
                value = mix(np.array([value], np.uint64) + h)[0]
            whole[k] = value
        order = np.argsort(np.concatenate([owner, few]), kind="stable")
        shingles, owner = np.concatenate([shingles, whole])[order], np.concatenate([owner, few])[order]
    begin = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        shingles[a:b].sort()
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return shingles[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def _fingerprints(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that tell sets apart; the first is even. Of sets with shingles only."""
    full = first[:-1][np.diff(first) > 0]
    if not len(full):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = mix(np.add.reduceat(mix(sets ^ np.uint64(0x5BF0)), full)) & ~np.uint64(1)
    b = mix(np.add.reduceat(mix(sets + np.uint64(0xC2B2AE3D)), full))
    return a.view(np.int64), b.view(np.int64)


def _profiles(size: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_batches(batches, "row", "text"):
            sets, first = shingle_sets(texts, size)
            n = np.diff(first)
            a, b = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            a[n > 0], b[n > 0] = _fingerprints(sets, first)
            bands = [band_of(int(x)) if x else None for x in n]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["id"] for r in rows], pa.int64()),
                    pa.array([r["text_key"] for r in rows], pa.int64()),
                    *(pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(bands, pa.int32())),
                ],
                ["id", "text_key", "n", "fp", "fp2", "band"],
            )

    return run


def _signatures(sets: np.ndarray, owner: np.ndarray, count: int, band: int, how: Allocation):
    """Signatures of sets in one band's partition of the universe, and the set that each is of."""
    m = how.segments
    token = mix(sets)
    segment = (mix(token ^ np.uint64(band + 1)) % np.uint64(m)).astype(np.int64)
    total = np.zeros(count * m, np.uint64)
    np.add.at(total, owner * m + segment, token)
    salt = mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 32 | 1))
    sig = mix(total.reshape(count, m) + salt).ravel()
    of = np.repeat(np.arange(count), m)
    if how.deletions:
        without = mix(total[owner * m + segment] - token + salt[segment])
        sig, of = np.concatenate([sig, without]), np.concatenate([of, owner])
    return sig, of


def _index(size: int, plan: dict[int, Allocation], like: Similarity):
    def run(batches) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, texts in text_batches(batches, "id", "text"):
            sets, first = shingle_sets(texts, size)
            n = np.diff(first)
            full = np.flatnonzero(n)
            fp = _fingerprints(sets, first)[0]
            fresh = []
            for k, f in enumerate(fp.tolist()):  # a copy of a set seen in this task adds nothing
                if f not in seen:
                    seen.add(f)
                    fresh.append(k)
            if not fresh:
                continue
            limits = band_limits(int(n.max()))
            by: dict[tuple[int, int], list[int]] = {}
            for k in fresh:
                size_k = int(n[full[k]])
                band = band_of(size_k)
                by.setdefault((band, 0), []).append(k)
                if band and like.partner(limits[band - 1][1]) >= size_k:
                    by.setdefault((band - 1, 1), []).append(k)
            for (band, lower), members in by.items():
                at = full[members]
                parts = [sets[first[d] : first[d + 1]] for d in at]
                owner = np.repeat(np.arange(len(at)), n[at])
                how = plan.get(band)
                if how is None:  # no set has this band as its own
                    continue
                sig, of = _signatures(np.concatenate(parts), owner, len(at), band, how)
                keys = fp[members][of] | lower
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(keys)], ["sig", "key"])

    return run


def _met(batches) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by sig and key: those of signatures with two sets or more, with their number (up to COUNTED)."""
    sig, key = np.zeros(0, np.int64), np.zeros(0, np.int64)
    counted = 0  # of the run held back, rows that went out already

    def emit(s, k, c):
        return pa.RecordBatch.from_arrays([pa.array(s), pa.array(k), pa.array(c.astype(np.int32))], ["sig", "key", "sets"])

    def runs(s, k, last):
        nonlocal sig, key, counted
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (k[1:] != k[:-1])
        s, k = s[new], k[new]
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(starts, len(s)))
        total = lengths.copy()
        if len(total):
            total[0] += counted
        hold = 0
        if not last and len(lengths):
            if total[-1] >= COUNTED:  # long enough: goes out now, only its last row stays for comparison
                hold = 1
                next_counted = int(total[-1]) - 1
            else:
                hold = int(lengths[-1])
                next_counted = int(total[-1]) - hold
        else:
            next_counted = 0
        each = np.repeat(np.minimum(total, COUNTED), lengths)
        out = slice(0, len(s) - hold)
        sig, key, counted = s[len(s) - hold :], k[len(k) - hold :], next_counted
        keep = each[out] > 1
        return emit(s[out][keep], k[out][keep], each[out][keep])

    for batch in batches:
        s = np.concatenate([sig, batch.column("sig").to_numpy()])
        k = np.concatenate([key, batch.column("key").to_numpy()])
        yield runs(s, k, last=False)
    yield runs(sig, key, last=True)


def _sets(size: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_batches(batches, "of", "text"):
            sets, first = shingle_sets(texts, size)
            n = np.diff(first)
            fp = np.zeros(len(n), np.int64)
            fp[n > 0] = _fingerprints(sets, first)[0]
            mine = [d for d, key in enumerate(keys) if key["fp"] == fp[d]]
            bodies = [sets[first[d] : first[d + 1]].tobytes() for d in mine]
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[d]["class"] for d in mine], pa.int64()), pa.array(bodies, pa.binary())], ["class", "shingles"]
            )

    return run


def linked_sets(sets: list[np.ndarray], like: Similarity) -> np.ndarray:
    """Which of the sets link, as a matrix with a false diagonal."""
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    distinct, of, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1  # of those in two sets or more
    shared = times[of] > 1
    owner, column = owner[shared], column[of[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int((times > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        both += part @ part.T
    linked = like.whole * both.astype(np.int64) >= like.part * (size[:, None] + size[None, :] - both.astype(np.int64))
    np.fill_diagonal(linked, False)
    return linked


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """The links of a spanning forest."""
    out, left = [], np.ones(len(linked), bool)
    for start in range(len(linked)):
        if not left[start]:
            continue
        left[start] = False
        stack = [start]
        while stack:
            node = stack.pop()
            near = np.flatnonzero(linked[node] & left)
            left[near] = False
            out += [(node, int(x)) for x in near]
            stack += near.tolist()
    return out


def _compared(like: Similarity):
    """A forest of the links (a, b) in two blocks, and how many documents each class (a) links with there."""

    def run(table: pa.Table) -> pa.Table:
        classes, at = np.unique(table.column("class").to_numpy(), return_index=True)  # a text may come twice
        table = table.take(pa.array(at))
        linked = linked_sets([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")], like)
        copies, block = table.column("copies").to_numpy(), table.column("block").to_numpy()
        pairs = linked if table.column("low")[0] == table.column("high")[0] else linked & (block[:, None] != block[None, :])
        edges = forest(linked)
        a = [*classes[[x for x, _ in edges]], *classes] if edges else list(classes)
        b = [*classes[[y for _, y in edges]], *([None] * len(classes))] if edges else [None] * len(classes)
        n = [None] * len(edges) + (pairs @ copies).tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n_links": pa.array(n, pa.int64())})

    return run


def similar_documents(
    documents: DataFrame, size: int = 5, like: Similarity = Similarity(), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``id_column``, ``n_shingles``, ``component_id``, ``n_links`` for each row of ``documents``.

    Words are lower-cased (A-Z) runs of other than white space; a set holds the
    distinct windows of ``size`` words, or the whole sequence if it is shorter. Rows
    link if the Jaccard similarity is at least ``like``; a component is named by
    the smallest id in it, and ``n_links`` counts the other rows a row links with.
    Texts that are null or have no words have no shingles and are a component of their
    own. Rows that share an id are rows of their own; a row without id links with nothing
    and has no component. Other columns don't matter.
    """
    return grouped_rows(documents, size, like, id_column, text_column).select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id", "n_links"
    )


def text_key(text: Column | str) -> Column:
    """Tells texts under one id apart."""
    return F.xxhash64(text)


def grouped_rows(
    documents: DataFrame, size: int = 5, like: Similarity = Similarity(), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``id, text_key, n, component, component_id, n_links`` of each row.

    ``component`` numbers the components: rows that share an id may be of two components
    whose smallest id is the same. It is null for rows without id or shingles.
    """
    spark = documents.sparkSession
    ship(spark)
    texts = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("binary").alias("text"))
    texts = texts.withColumn("text_key", text_key("text"))
    profiled = texts.select(F.struct("id", "text_key").alias("row"), "text")
    profiles = stored(profiled.mapInArrow(_profiles(size), "id long, text_key long, n long, fp long, fp2 long, band int"), "profiles")
    classes = (
        profiles.filter("n > 0 and id is not null")
        .groupBy("fp", "fp2", "n", "band")
        .agg(F.min(F.struct("id", "text_key")).alias("first"), F.count("*").alias("copies"))
        .select("fp", "fp2", "n", "band", "copies", F.col("first.id").alias("first"), F.col("first.text_key").alias("first_text"))
        .withColumn("class", F.monotonically_increasing_id())
        .withColumn("twins", F.count("*").over(Window.partitionBy("fp")))
    )
    classes = stored(classes, "classes")

    counts = {r["band"]: r["count"] for r in classes.groupBy("band").count().collect()}  # tens of bands
    if not counts:
        return _answer(profiles, classes, None)
    limits = band_limits(band_limits(1)[0][1])
    while len(limits) <= max(counts):
        limits = band_limits(limits[-1][1] + 1)
    plan = {b: allocate(*limits[b], counts[b], like) for b in counts}

    rows = sum(counts[b] * (p.segments + p.deletions * limits[b][1]) for b, p in plan.items())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(1.4 * rows / PARTITION_ROWS))
    met = (
        texts.filter("id is not null")
        .mapInArrow(_index(size, plan, like), "sig long, key long")
        .repartition(parts, "sig")
        .sortWithinPartitions("sig", "key")
        .mapInArrow(_met, "sig long, key long, sets int")
    )
    met = stored(met, "met")

    # as literals: rows from Python lists would start other Python workers on the executors
    each = [
        F.struct(F.lit(b).alias("in_band"), F.lit(p.segments).alias("segments"), F.lit(p.deletions).alias("deletions"), F.lit(limits[b][1]).cast("long").alias("high"))
        for b, p in plan.items()
    ]
    bands = spark.range(1).select(F.inline(F.array(*each)))
    # For each set and partition of the universe, the rarest H + 1 signatures; those it shares with nobody come first.
    n, partner = F.col("n"), F.floor(F.col("n") * like.whole / F.lit(like.part))
    differ = F.floor((n + F.when(F.col("lower") == 1, F.col("high")).otherwise(partner)) * (like.whole - like.part) / F.lit(like.whole + like.part))
    own = Window.partitionBy("fp", "class", "lower")
    live = (
        met.select("sig", "sets", F.expr("key & ~1L").alias("fp"), F.expr("key & 1L").alias("lower"))
        .join(classes.select("fp", "class", "n", "band", "twins"), "fp")
        .withColumn("in_band", (F.col("band") - F.col("lower")).cast("int"))
        .join(F.broadcast(bands), "in_band")  # tens of rows
        .withColumn("differ", differ)
        .withColumn("shared", F.count("*").over(own))
        .withColumn("rank", F.row_number().over(own.orderBy("sets", "sig")))
        .filter("deletions or twins > 1 or rank <= differ + 1 - (segments - shared)")
        .select("sig", "class")
    )
    live = stored(live, "live")

    # Families: what meets in a bucket, and different sets with one fingerprint.
    hubs = live.groupBy("sig").agg(F.min("class").alias("a"), F.count("*").alias("k")).filter("k > 1").select("sig", "a")
    twins = classes.filter("twins > 1").select("fp", "class", "n")
    alike = twins.join(twins.groupBy("fp").agg(F.min("class").alias("a")), "fp").select("a", "class")
    meetings = live.join(hubs, "sig").select("a", "class").union(alike).toDF("a", "b")
    families = components(meetings)
    members = families.toDF("class", "family").join(classes.select("class", "n", "copies"), "class")
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).alias("blocks")
    members = stored(members.join(members.groupBy("family").agg(blocks), "family"), "members")
    placed = (
        members.withColumn("block", F.pmod(F.xxhash64("class"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("class", "copies", "family", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )
    links = (
        placed.join(_class_sets(texts, classes, members.select("class"), size), "class")
        .groupBy("family", "low", "high")
        .applyInArrow(_compared(like), "a long, b long, n_links long")
    )
    return _answer(profiles, classes, stored(links, "links"))


def _class_sets(texts: DataFrame, classes: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """The shingles of each needed class, from the text of its first document.

    Texts that a bitmap of the wanted keys rules out stay where they are.
    """
    wanted = classes.join(needed, "class", "left_semi")
    wanted = wanted.select(F.col("first").alias("id"), F.col("first_text").alias("text_key"), F.struct("class", "fp").alias("of"))
    wanted = stored(wanted, "wanted")
    near = with_flag(texts, key_bitmap(wanted, "id", "text_key"), "wanted", "id", "text_key").filter("wanted")
    return near.join(wanted, ["id", "text_key"]).select("of", "text").mapInArrow(_sets(size), "class long, shingles binary")


def _answer(profiles: DataFrame, classes: DataFrame, links: DataFrame | None) -> DataFrame:
    own = classes.select("fp", "fp2", "class", "first", "copies")
    if links is not None:
        groups = components(links.filter("b is not null").select("a", "b"))
        more = links.filter("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n_links").alias("n_links"))
        named = own.join(groups.toDF("class", "group"), "class", "left").join(more, "class", "left")
        named = named.withColumn("component", F.coalesce("group", "class"))
        smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
        named = named.join(smallest, "component")
    else:
        named = own.withColumns({"component": F.col("class"), "component_id": F.col("first"), "n_links": F.lit(0).cast("long")})
    linked = F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))
    named = named.select("fp", "fp2", "component", "component_id", linked.cast("long").alias("n_links"))
    found = profiles.join(named, ["fp", "fp2"], "left")
    in_one = F.col("id").isNotNull() & (F.col("n") > 0)
    return found.select(
        "id",
        "text_key",
        "n",
        F.when(in_one, F.col("component")).alias("component"),
        F.when(F.col("id").isNull(), None).when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(in_one, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )
