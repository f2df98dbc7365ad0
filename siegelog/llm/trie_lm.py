"""Language-model scoring with an n-gram trie in Elias-Fano levels.

Tokens are lower-cased (A-Z) words and one end per text. The model is an
absolutely discounted bigram model, interpolated with the add-0.1 unigrams:

    p(w | h) = max(c(hw) - D, 0) / c(h) + D * types(h) / c(h) * unigram(w)

with D from the counts of counts of all pairs. It is trained on all texts whose
crc32 of the id is not 0 modulo 10, and grows with them, so it is not sent to every
executor: contexts are dealt over shards, and each shard is a trie of its own with
the levels *contexts*, *pointers* and *successors*. All three are monotone and
Elias-Fano coded; a successor is stored relative to its context's base, and a
query is a successor search between the context's two pointers. Discounted
probabilities and back-off weights are quantised to 8 bits. The levels are a memory-mapped
file of the task that holds the shard.

Texts are turned into batches of word numbers once (a stored table). A batch asks
each shard for its distinct words and pairs and gets the answers back in the
order of its questions, so what is shuffled are a few large rows for each batch and
shard. A context with over 1 / HOT of all tokens (at most HOT words, hence a
broadcast list) is dealt over all shards by its successors. Before the tries are
built, the counts of counts and the successors of hot contexts are summed over all
shards, so the model doesn't depend on how many there are (but for the quantisation).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siegelog.llm.elias_fano import EliasFano, Levels
from siegelog.llm.storage import ship, stored
from siegelog.llm.wordhash import mix, text_batches, words

# Tokens of the corpus for each shard.
SHARD_TOKENS = 2_000_000
# A context with more than this part of all tokens is dealt over all shards.
HOT = 1000
ADDED = 0.1
# Text in a batch: the larger, the fewer words and pairs are asked for more than once.
BATCH_BYTES = 12 << 20
_END, _BEGIN = np.uint64(0xE0D), np.uint64(0xBE61)  # stand for the hashes of the two signs

_BATCH = "batch long, ids binary, held_out binary, first binary, vocabulary binary, tokens binary, train_tokens long, train_docs long"
_NAMES = ["batch", "ids", "held_out", "first", "vocabulary", "tokens", "train_tokens", "train_docs"]


def _shrunk(a: np.ndarray) -> bytes:
    """Compressed byte by byte of the numbers: all first bytes, all second ones and so on."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T if len(a) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _grown(body, dtype) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(body)), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _batches_of(batches) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    context = TaskContext.get()
    number = context.partitionId() << 33 if context else 0
    for ids, texts in text_batches(batches, "id", "text", BATCH_BYTES):
        w = words(texts)
        vocabulary, tokens, times = np.unique(w.hashes(lower=True), return_inverse=True, return_counts=True)
        frequent = np.argsort(-times, kind="stable")  # frequent words have small numbers, which take less room
        number_of = np.empty_like(frequent)
        number_of[frequent] = np.arange(len(frequent))
        vocabulary, tokens = vocabulary[frequent], number_of[tokens]
        held = np.array([is_held_out(i) for i in ids])
        sizes = np.diff(w.first)
        row = [
            number,
            pa.array(ids, pa.int64()).fill_null(0).to_numpy().tobytes(),
            bytes(int(h) | (i is None) << 1 for i, h in zip(ids, held, strict=True)),
            w.first.tobytes(),
            vocabulary.tobytes(),
            _shrunk(tokens.astype(np.int32)),
            int((sizes + 1)[~held].sum()),
            int((~held).sum()),
        ]
        number += 1
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], _NAMES)


class Batch:
    """Texts as word numbers: those of the vocabulary, then the end and the beginning."""

    def __init__(self, row: dict) -> None:
        self.ids = np.frombuffer(row["ids"], np.int64)
        flags = np.frombuffer(row["held_out"], np.uint8)
        self.held, self.no_id = (flags & 1).astype(bool), (flags & 2).astype(bool)
        first = np.frombuffer(row["first"], np.int64)
        own = np.frombuffer(row["vocabulary"], np.uint64)
        self.words = len(own)
        self.hashes = np.concatenate([own, [_END, _BEGIN]])
        tokens = _grown(row["tokens"], np.int32)
        count = len(first) - 1
        self.first = first + np.arange(count + 1)  # with an end for each text
        self.tokens = np.full(len(tokens) + count, self.words, np.int64)
        is_word = np.ones(len(self.tokens), bool)
        is_word[self.first[1:] - 1] = False
        self.tokens[is_word] = tokens
        self.text_of = np.repeat(np.arange(count), np.diff(self.first))

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[~self.held[self.text_of]], minlength=self.words + 2)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs as contexts and words, how often each is in training texts, and each token's pair."""
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.first[:-1]] = self.words + 1
        code, of = np.unique(before * (self.words + 2) + self.tokens, return_inverse=True)
        counts = np.bincount(of, ~self.held[self.text_of], len(code)).astype(np.int32)
        return code // (self.words + 2), code % (self.words + 2), counts, of

    def pair_shards(self, contexts: np.ndarray, followers: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
        h, w = self.hashes[contexts], self.hashes[followers]
        return (np.where(np.isin(h, hot), mix(h + mix(w)), mix(h)) % np.uint64(shards)).astype(np.int64)


def _parts(shard: np.ndarray, shards: int, by: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order by shard, within it by ``by``, and where each shard begins."""
    order = np.argsort(shard, kind="stable") if by is None else np.lexsort((by, shard))
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _ask_words(shards: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Batch(row)
                counts = b.word_counts()[: b.words].astype(np.int32)
                order, at = _parts((mix(b.hashes[: b.words]) % np.uint64(shards)).astype(np.int64), shards, b.hashes[: b.words])
                rows = [
                    (s, row["batch"], _shrunk(b.hashes[order[x:y]]), _shrunk(counts[order[x:y]]))
                    for s, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True))
                    if x < y
                ]
                columns = zip(*rows, strict=True) if rows else ([], [], [], [])
                types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["shard", "batch", "words", "counts"])

    return run


def _answer_words(tokens: int):
    """Counts of a shard's words over all training texts; frequent words and the number of distinct ones apart."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [_grown(r["words"], np.uint64) for r in rows]
        distinct, of = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(of, np.concatenate([_grown(r["counts"], np.int32) for r in rows])).astype(np.int64)
        out, at = [], 0
        for r, part in zip(rows, parts, strict=True):
            out.append((r["batch"], r["shard"], _shrunk(total[of[at : at + len(part)]]), None, None))
            at += len(part)
        out.append((None, None, None, None, int((total > 0).sum())))
        out += [(None, None, None, int(distinct[k : k + 1].view(np.int64)[0]), int(total[k])) for k in np.flatnonzero(total * HOT > tokens)]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["batch", "shard", "counts", "word", "number"])

    return run


_ANSWERED = ["batch", "shard", "codes", "weights", "books"]
_ANSWERED_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_PAIRS = ["shard", "batch", "contexts", "context_of", "words", "word_of", "counts"]


def _listed(hashes: np.ndarray, numbers: np.ndarray) -> tuple[bytes, bytes]:
    """Distinct hashes, and which of them each number has."""
    distinct, of = np.unique(numbers, return_inverse=True)
    return _shrunk(hashes[distinct]), _shrunk(of.astype(np.int32))


def _ask_pairs(shards: int, hot: np.ndarray):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Batch(row)
                contexts, followers, counts, _ = b.pairs()
                order, at = _parts(b.pair_shards(contexts, followers, shards, hot), shards)
                rows = []
                for s, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    if x < y:
                        own = order[x:y]
                        rows.append((s, row["batch"], *_listed(b.hashes, contexts[own]), *_listed(b.hashes, followers[own]), _shrunk(counts[own])))
                columns = zip(*rows, strict=True) if rows else ([],) * len(_PAIRS)
                types = [pa.int32(), pa.int64()] + [pa.binary()] * 5
                names = _PAIRS
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def _quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes, and what they stand for: 255 even steps of the logarithm; code 0 is left for what is absent."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(256, np.float64)
    logs = np.log10(values)
    low, high = float(logs.min()), float(logs.max())
    step = (high - low) / 254 or 1.0
    codes = np.rint((logs - low) / step).astype(np.int64) + 1
    book = np.concatenate([[0.0], 10.0 ** (low + step * np.arange(255))])
    return codes.astype(np.uint8), book


def _successors(contexts: np.ndarray, followers: np.ndarray, counts: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts, words, numbers of the distinct pairs (context times words plus word) and their counts in training texts.

    Hot contexts that are asked for are there without pairs too.
    """
    seen = counts > 0
    h = np.unique(contexts[seen | np.isin(contexts, hot)])
    w, of_w = np.unique(followers[seen], return_inverse=True)
    value, of = np.unique(np.searchsorted(h, contexts[seen]) * max(1, len(w)) + of_w, return_inverse=True)
    return h, w, value, np.bincount(of, counts[seen]).astype(np.int64)


class Trie:
    """A shard's contexts and their successors."""

    def __init__(self, contexts: np.ndarray, followers: np.ndarray, counts: np.ndarray, hot: dict[int, tuple[int, int]], cut: float) -> None:
        """Of pairs (hashes), which may repeat, with their counts in training texts.

        ``hot`` has the count and the types of each hot context, ``cut`` is the discount.
        """
        h, w, value, count = _successors(contexts, followers, counts, np.array(sorted(hot), np.uint64))
        self.width = max(1, len(w))
        owner = value // self.width
        total, types = np.bincount(owner, count, len(h)), np.bincount(owner, minlength=len(h)).astype(np.float64)
        for k, x in enumerate(h.tolist()):
            if x in hot:
                total[k], types[k] = hot[x]
        code, self.book = _quantised((count - cut) / total[owner])
        weight, self.weights = _quantised(np.minimum(1.0, cut * types / total))
        levels = Levels()
        self.contexts = EliasFano(levels, "contexts", h, 1 << 64)
        self.words = EliasFano(levels, "words", w, 1 << 64)
        self.pointers = EliasFano(levels, "pointers", np.searchsorted(owner, np.arange(len(h) + 1)), len(value) + 1)
        self.successors = EliasFano(levels, "successors", value, max(1, len(h) * self.width))
        levels.put("code", code)
        levels.put("weight", weight)
        for level in (self.contexts, self.words, self.pointers, self.successors):
            level.open()
        self.code, self.weight = levels.get("code"), levels.get("weight")

    def codes(self, contexts: np.ndarray, followers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each pair's discounted probability and its context's back-off weight; 0 if absent."""
        distinct, of = np.unique(contexts, return_inverse=True)
        node = self.contexts.find(distinct)
        known = node >= 0
        begin, end = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        begin[known] = self.pointers.access(node[known]).astype(np.int64)
        end[known] = self.pointers.access(node[known] + 1).astype(np.int64)
        weight = np.zeros(len(node), np.uint8)
        weight[known] = self.weight[node[known]]

        distinct_words, of_word = np.unique(followers, return_inverse=True)
        word = self.words.find(distinct_words)[of_word]
        ask = np.flatnonzero(known[of] & (word >= 0))
        base = node[of[ask]] * self.width  # a successor's number is relative to its context
        at = self.successors.successor((base + word[ask]).astype(np.uint64))
        inside = (at >= begin[of[ask]]) & (at < end[of[ask]])
        ask, at, base = ask[inside], at[inside], base[inside]
        found = self.successors.access(at).astype(np.int64) == base + word[ask]
        out = np.zeros(len(contexts), np.uint8)
        out[ask[found]] = self.code[at[found]]
        return out, weight[of]


def _pairs_of(rows: list[dict]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Contexts and words of each row, and the counts of all."""
    followers = [_grown(r["words"], np.uint64)[_grown(r["word_of"], np.int32)] for r in rows]
    contexts = [_grown(r["contexts"], np.uint64)[_grown(r["context_of"], np.int32)] for r in rows]
    return contexts, followers, np.concatenate([_grown(r["counts"], np.int32) for r in rows])


def _count_pairs(hot: np.ndarray):
    """Of a shard: how many pairs are there once and twice, and the types of each hot context, in rows of their own."""

    def run(table: pa.Table) -> pa.Table:
        contexts, followers, counts = _pairs_of(table.to_pylist())
        h, w, value, count = _successors(np.concatenate(contexts), np.concatenate(followers), counts, hot)
        types = np.bincount(value // max(1, len(w)), minlength=len(h))
        own = np.flatnonzero(np.isin(h, hot) & (types > 0))
        columns = [
            pa.array([None, *h[own].view(np.int64).tolist()], pa.int64()),
            pa.array([0, *types[own].tolist()], pa.int64()),
            pa.array([int((count == 1).sum())] + [0] * len(own), pa.int64()),
            pa.array([int((count == 2).sum())] + [0] * len(own), pa.int64()),
        ]
        return pa.table(columns, ["context", "types", "once", "twice"])

    return run


def _answer_pairs(hot: dict[int, int]):
    def run(table: pa.Table, totals: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        if not rows:
            return pa.table([pa.array([], t) for t in _ANSWERED_TYPES], _ANSWERED)
        contexts, followers, counts = _pairs_of(rows)
        of_all = totals.to_pylist()[0]
        once, twice = of_all["once"] or 0, of_all["twice"] or 0
        cut = min(0.95, once / (once + 2 * twice)) if once else 0.5
        types_of = {x["context"] & (1 << 64) - 1: x["types"] for x in of_all["hot"] if x["context"] is not None}
        trie = Trie(np.concatenate(contexts), np.concatenate(followers), counts, {k: (hot[k], t) for k, t in types_of.items()}, cut)
        books = np.stack([trie.book, trie.weights]).tobytes()
        out = []
        for r, h, w in zip(rows, contexts, followers, strict=True):
            code, weight = trie.codes(h, w)
            out.append((r["batch"], r["shard"], _shrunk(code), _shrunk(weight), books))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ANSWERED_TYPES, strict=True)], _ANSWERED)

    return run


_SCORED = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]
_SCORED_TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def _scores(shards: int, hot: np.ndarray, tokens: int, docs: int, distinct: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in _SCORED_TYPES], _SCORED)
        b = Batch(left.to_pylist()[0])
        answers = {(r["counts"] is None, r["shard"]): r for r in right.to_pylist()}
        count = np.zeros(b.words + 2, np.int64)
        count[b.words] = docs
        order, at = _parts((mix(b.hashes[: b.words]) % np.uint64(shards)).astype(np.int64), shards, b.hashes[: b.words])
        for s, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if x < y:
                count[order[x:y]] = _grown(answers[False, s]["counts"], np.int64)
        unigram = (count + ADDED) / (tokens + ADDED * (distinct + 1))
        contexts, followers, _, of = b.pairs()
        p = np.empty(len(contexts))
        order, at = _parts(b.pair_shards(contexts, followers, shards, hot), shards)
        for s, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if x < y:
                own, r = order[x:y], answers[True, s]
                books = np.frombuffer(r["books"], np.float64).reshape(2, 256)
                weight = _grown(r["weights"], np.uint8)
                back = np.where(weight > 0, books[1][weight], 1.0)
                p[own] = books[0][_grown(r["codes"], np.uint8)] + back * unigram[followers[own]]
        n = len(b.ids)
        out = [
            pa.array(b.ids, mask=b.no_id),
            pa.array(b.held),
            pa.array(np.diff(b.first)),
            pa.array(np.bincount(b.text_of, count[b.tokens] > 0, n).astype(np.int64)),
            pa.array(np.bincount(b.text_of, np.log10(unigram)[b.tokens], n)),
            pa.array(np.bincount(b.text_of, np.log10(p)[of], n)),
        ]
        return pa.table(out, _SCORED)

    return run


def score_documents(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of each row.

    ``base_score`` is log10 of the text's probability under the add-0.1 unigrams alone,
    ``score`` under the model. A null text is empty and has one token, its end. A
    row without id counts as one with an empty id, which is held out. Repeated rows count
    as often as they come. Without training texts both scores are those of an
    unknown token: log10 of 1.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("binary").alias("text"))
    batches = stored(rows.mapInArrow(_batches_of, _BATCH), "batches")
    sums = batches.agg(F.sum("train_tokens"), F.sum("train_docs")).first()
    tokens, docs = int(sums[0] or 0), int(sums[1] or 0)
    shards = tokens // SHARD_TOKENS + 1

    asked = batches.mapInArrow(_ask_words(shards), "shard int, batch long, words binary, counts binary")
    counted = stored(
        asked.groupBy("shard").applyInArrow(_answer_words(tokens), "batch long, shard int, counts binary, word long, number long"), "words"
    )
    frequent = {r["word"]: r["number"] for r in counted.filter("word is not null").collect()}  # HOT words at most
    distinct = counted.filter("batch is null and word is null").agg(F.sum("number")).first()[0] or 0
    hot = {int(np.int64(k).view(np.uint64)): v for k, v in frequent.items()} | {int(_BEGIN): docs}
    hot_hashes = np.array(sorted(hot), np.uint64)

    asked = batches.mapInArrow(_ask_pairs(shards, hot_hashes), "shard int, batch long, contexts binary, context_of binary, words binary, word_of binary, counts binary")
    # One row, given to each shard; in the same query, so that the pairs are shuffled once.
    totals = (
        asked.groupBy("shard")
        .applyInArrow(_count_pairs(hot_hashes), "context long, types long, once long, twice long")
        .groupBy("context")
        .agg(F.sum("types").alias("types"), F.sum("once").alias("once"), F.sum("twice").alias("twice"))
        .agg(F.collect_list(F.struct("context", "types")).alias("hot"), F.sum("once").alias("once"), F.sum("twice").alias("twice"))
    )
    each = spark.range(shards).select(F.col("id").cast("int").alias("shard")).crossJoin(F.broadcast(totals))
    paired = asked.groupBy("shard").cogroup(each.groupBy("shard")).applyInArrow(
        _answer_pairs(hot), "batch long, shard int, codes binary, weights binary, books binary"
    )
    answers = (
        counted.filter("batch is not null")
        .select("batch", "shard", "counts", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("weights"), F.lit(None).cast("binary").alias("books"))
        .unionByName(paired.withColumn("counts", F.lit(None).cast("binary")))
    )
    scored = (
        batches.groupBy("batch")
        .cogroup(answers.groupBy("batch"))
        .applyInArrow(
            _scores(shards, hot_hashes, tokens, docs, distinct + (docs > 0)),
            "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double",
        )
    )
    return scored.select(
        F.col("id").alias(id_column), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
