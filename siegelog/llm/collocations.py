"""Collocations: frequent phrases mined by partitions, counted exactly, scored by their weakest cut.

Documents are dealt to shards by a hash of their id. A phrase that has the support in
the whole of a language reaches, in one shard at least, the support times the shard's
part of the language's words. So each shard is mined completely at that local support,
level by level (a phrase is frequent only if its words and word pairs are), and the
union over the shards holds every frequent phrase. One more pass counts that union
exactly, as texts.

Mining works on 64-bit hashes, which may only add candidates, as counts of colliding
phrases add up. Sets of hashes reach the tasks as a bitmap of a fixed size
(2^``BITS`` bits, 32 MB); what it lets through in addition fails the exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siegelog.llm.storage import ship, stored
from siegelog.llm.wordhash import _LOWER, batches, mix

# Few, as the local support must stay well above 1.
SHARDS = 2
BITS = 28
# Bytes of text in a batch; each takes some 60 bytes of arrays. A longer text is a batch of its own.
BATCH = 1 << 20

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
# Spreads the shards over the bitmap.
_SHARD = 2654435761
_MASK = (1 << BITS) - 1

# Bytes that end a piece, and those that end a word.
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


class Tokens:
    """Words of a batch of rows (lang, shard, need, text): exact codes, hashes and pieces."""

    def __init__(self, rows: list[tuple]) -> None:
        data = _LOWER[np.frombuffer(b"\n".join([*(r[3] for r in rows), b""]), np.uint8)]
        inside = ~_GAP[data]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        self.piece = np.cumsum(_BREAK[data], dtype=np.int64)[starts]
        begin = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r[3]) + 1 for r in rows], out=begin[1:])
        row = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(np.searchsorted(starts, begin)))
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
        self.texts = coded.dictionary
        self.code = coded.indices.to_numpy()
        self.langs = sorted({r[0] for r in rows})
        place = {x: k for k, x in enumerate(self.langs)}
        self.lang = np.array([place[r[0]] for r in rows], np.int32)[row]
        self.shard = np.array([r[1] for r in rows], np.int32)[row]
        self.need = np.array([r[2] for r in rows], np.int64)[row]
        own = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in self.texts.to_pylist()), np.uint64, len(self.texts))
        of_lang = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs], np.uint64)
        self.own, self.of_lang = own, of_lang
        self.word = own[self.code]
        self.grams = [self.first(self.lang, self.code)]

    def first(self, lang: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Hashes of words of a language, from their codes."""
        return mix(self.of_lang[lang] * _FACTOR + self.own[code])

    def hashes(self, size: int) -> np.ndarray:
        """Of the phrases of ``size`` words that begin at each word, language included."""
        while len(self.grams) < size:
            last = self.grams[-1][:-1]
            self.grams.append(mix(last * _FACTOR + self.word[len(self.grams) :]))
        return self.grams[size - 1]

    def whole(self, size: int) -> np.ndarray:
        """Whether the phrases lie within a piece."""
        n = max(0, len(self.piece) - size + 1)
        return self.piece[:n] == self.piece[size - 1 : size - 1 + n]

    def all_of(self, fits: np.ndarray, parts: int) -> np.ndarray:
        """Where ``parts`` neighbours fit."""
        n = max(0, len(fits) - parts + 1)
        out = fits[:n].copy()
        for k in range(1, parts):
            out &= fits[k : n + k]
        return out


def _place(keys: np.ndarray, shard: np.ndarray | None) -> np.ndarray:
    if shard is None:
        return (keys & np.uint64(_MASK)).astype(np.int64)
    return (((keys >> np.uint64(20)).astype(np.int64)) ^ (shard.astype(np.int64) * _SHARD)) & _MASK


def _place_of(key: str, shard: str | None) -> Column:
    """The same bit as ``_place``, as a column."""
    if shard is None:
        return F.col(key).bitwiseAND(F.lit(_MASK))
    return F.shiftright(key, 20).bitwiseXOR(F.col(shard).cast("long") * F.lit(_SHARD)).bitwiseAND(F.lit(_MASK))


def _bitmap(df: DataFrame, place: Column):
    """A broadcast bitmap of the places; 2^BITS / 8 bytes, whatever the number of rows."""
    bit = place + 1
    parts = df.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for part, bits in parts.toLocalIterator():
        out[(part - 1) * len(bits) : part * len(bits)] = np.frombuffer(bytes(bits), np.uint8)
    return df.sparkSession.sparkContext.broadcast(out)


def _has(bitmap, places: np.ndarray) -> np.ndarray:
    return (bitmap.value[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def _batches(arrow_batches) -> Iterator[Tokens]:
    def rows() -> Iterator[tuple]:
        for batch in arrow_batches:
            langs, shards, needs = (batch.column(n).to_pylist() for n in ("lang", "shard", "need"))
            for lang, shard, need, body in zip(langs, shards, needs, batch.column("text"), strict=True):
                yield (lang, shard, need, body.as_py()), body.as_py()

    for held in batches(rows(), BATCH):
        yield Tokens([r[0] for r in held])


def _words(arrow_batches) -> Iterator[pa.RecordBatch]:
    """Counts of words by shard and language."""
    for t in _batches(arrow_batches):
        if not len(t.code):
            continue
        counts = np.bincount((t.shard.astype(np.int64) * len(t.langs) + t.lang) * len(t.texts) + t.code)
        cells = np.flatnonzero(counts)
        (shard, lang), code = np.divmod(cells // len(t.texts), len(t.langs)), cells % len(t.texts)
        langs = pa.DictionaryArray.from_arrays(pa.array(lang, pa.int32()), pa.array(t.langs)).cast(pa.string())
        words = t.texts.take(pa.array(code)).cast(pa.large_string()).cast(pa.string())
        columns = [pa.array(shard), langs, words, pa.array(t.first(lang, code).view(np.int64)), pa.array(counts[cells])]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "lang", "word", "key", "n"])


def _miner(lower, size_below: int, sizes: tuple[int, ...]):
    """Counts of hashes of phrases whose parts of ``size_below`` words are all frequent in the shard."""

    def run(arrow_batches) -> Iterator[pa.RecordBatch]:
        for t in _batches(arrow_batches):
            if not len(t.code):
                continue
            below = t.hashes(size_below)
            fits = _has(lower, _place(below, t.shard[: len(below)])) & t.whole(size_below)
            for size in sizes:
                at = np.flatnonzero(t.whole(size) & t.all_of(fits, size - size_below + 1)[: max(0, len(t.code) - size + 1)])
                if not len(at):
                    continue
                keys, cell = t.hashes(size)[at], t.shard[at] * len(t.langs) + t.lang[at]
                for k in np.flatnonzero(np.bincount(cell)):  # of one shard and language, so of one local support
                    own = cell == k
                    found, n = np.unique(keys[own], return_counts=True)
                    shard, need = k // len(t.langs), t.need[at[np.argmax(own)]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n), shard)), pa.array(np.full(len(n), need)), pa.array(found.view(np.int64)), pa.array(n)],
                        ["shard", "need", "key", "n"],
                    )

    return run


def _equal_runs(t: Tokens, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct phrase (with its language) among those that begin at ``at``, and how often it is there.

    Phrases are sorted by hash; then codes decide, so that the counts are exact.
    """
    keys = t.hashes(size)[at]
    at = at[np.argsort(keys)]
    new = np.ones(len(at), bool)
    keys = t.hashes(size)[at]
    new[1:] = keys[1:] != keys[:-1]
    run = np.cumsum(new) - 1
    first = at[new]
    same = t.lang[at] == t.lang[first][run]
    for k in range(size):
        same &= t.code[at + k] == t.code[first + k][run]
    if same.all():
        return first, np.bincount(run, minlength=len(first))
    parts = np.stack([t.lang[at], *(t.code[at + k] for k in range(size))], axis=1)  # two phrases with one hash
    _, where, n = np.unique(parts, axis=0, return_index=True, return_counts=True)
    return at[where], n


def _counter(candidates, longest: int):
    """Exact counts of the phrases, as texts, whose hash is a candidate's."""

    def run(arrow_batches) -> Iterator[pa.RecordBatch]:
        for t in _batches(arrow_batches):
            texts = t.texts.cast(pa.large_string())
            for size in range(2, longest + 1):
                if len(t.code) < size:
                    break
                at = np.flatnonzero(t.whole(size))
                at = at[_has(candidates, _place(t.hashes(size)[at], None))]
                if not len(at):
                    continue
                first, n = _equal_runs(t, at, size)
                words = [texts.take(pa.array(t.code[first + k])) for k in range(size)]
                phrases = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())).cast(pa.string())
                langs = pa.DictionaryArray.from_arrays(pa.array(t.lang[first]), pa.array(t.langs)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([langs, phrases, pa.array(n)], ["lang", "phrase", "n"])

    return run


def frequent_phrases(
    documents: DataFrame,
    support: int = 30,
    longest: int = 4,
    shards: int = SHARDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): ``lang, phrase, size, f`` of all with f >= support; ``lang, n`` words."""
    ship(documents.sparkSession)
    rows = documents.select(
        F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"),
        F.pmod(F.xxhash64(id_column), F.lit(shards)).cast("long").alias("shard"),
        F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"),
    )
    counted = rows.select("lang", "shard", F.lit(0).cast("long").alias("need"), "text")
    words = counted.mapInArrow(_words, "shard long, lang string, word string, key long, n long")
    words = stored(words.groupBy("shard", "lang", "word").agg(F.max("key").alias("key"), F.sum("n").alias("n")), "phrase-words")
    parts = words.groupBy("lang", "shard").agg(F.sum("n").alias("own"))
    totals = stored(parts.groupBy("lang").agg(F.sum("own").alias("n")), "phrase-totals")
    # the support times the shard's part of the words, rounded up
    need = F.expr(f"cast((cast({support} as decimal(10,0)) * cast(own as decimal(20,0)) + cast(n as decimal(20,0)) - 1) div cast(n as decimal(20,0)) as bigint)")
    needs = stored(parts.join(totals, "lang").select("lang", "shard", need.alias("need")), "phrase-needs")
    rows = rows.join(needs, ["lang", "shard"]).select("lang", "shard", "need", "text")
    schema = "shard long, need long, key long, n long"

    def mined(lower, size_below: int, sizes: tuple[int, ...], name: str) -> DataFrame:
        local = rows.mapInArrow(_miner(lower, size_below, sizes), schema).groupBy("shard", "need", "key").agg(F.sum("n").alias("n"))
        return stored(local.filter("n >= need").select("shard", "key"), name)

    common = words.join(needs, ["lang", "shard"]).filter("n >= need")
    found = mined(_bitmap(common, _place_of("key", "shard")), 1, (2,), "phrase-pairs")
    candidates = found
    if longest > 2:
        more = mined(_bitmap(found, _place_of("key", "shard")), 2, tuple(range(3, longest + 1)), "phrase-longer")
        candidates = found.union(more)
    bitmap = _bitmap(candidates, _place_of("key", None))
    exact = rows.mapInArrow(_counter(bitmap, longest), "lang string, phrase string, n long")
    exact = exact.groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    single = words.groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("n").alias("f"))
    every = exact.unionByName(single).filter(F.col("f") >= support)
    every = every.withColumn("size", F.size(F.split("phrase", " ")))
    return stored(every.select("lang", "phrase", "size", "f"), "phrases"), totals


def scored(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, size, a, l, r, score`` of phrases of several words by the cut with the lowest score."""
    several = phrases.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.expr("explode(sequence(1, size - 1))").alias("k"))
    several = several.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - size)"))
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = several.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    best = cuts.groupBy("lang", "phrase", "size", "a").agg(lowest)
    return best.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def collocations(
    documents: DataFrame, support: int = 30, longest: int = 4, top: int = 2000, contained: int = 80, shards: int = SHARDS, **columns: str
) -> DataFrame:
    """The ``top`` phrases of two to ``longest`` words of each language.

    Texts are lower-cased (A-Z), pieces end at ``.,;:!?`` and the controls 10 to 13,
    words at blanks and tabs. ``a`` counts all occurrences of a phrase within pieces, ``l``
    and ``r`` those of the two parts of the cut with the lowest ``score`` (2,000,000 a /
    (l + r), rounded down; the first such cut); ``n`` counts the language's words. A
    phrase is left out if a longer frequent one that holds it has at least
    ``contained`` percent of its occurrences. ``rank`` goes by score, then a, then the
    phrase's bytes.

    A null text is empty, a null language ``und``; rows that share an id count each for
    itself; other columns are ignored; an empty table gives no row.
    """
    phrases, totals = frequent_phrases(documents, support, longest, shards, **columns)
    inner = F.expr(
        "flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), i -> array_join(slice(split(phrase, ' '), i, k), ' '))))"
    )
    longer = phrases.filter("size > 2").select("lang", F.col("f"), F.explode(F.array_distinct(inner)).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(24,0)")
    held = F.col("longer").isNotNull() & (wide("longer") * 100 >= wide("a") * contained)
    kept = scored(phrases).join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(held, F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
