"""Quality rules: plain counts of a text and the perplexity of its own language's model.

The model of a language is a modified Kneser-Ney model of n-grams of characters: each
Unicode character is a symbol of its own, but for the white space of ASCII, which is one.
Three code points are one 64-bit number, so n-grams are told apart exactly. Counts are made
by Spark over all rows, for every language there is. A model is a pair of arrays for each
order: the n-grams in order, found by binary search, and their values. Its size follows the
distinct n-grams of the language.

Models are stored by Spark, dealt to packs of at most ``PACK_BYTES`` (or one model), and a
pack is broadcast to score the texts of its languages. The number of packs, not their
size, follows the number of languages.

Texts quote other languages, lists and keys, so the perplexity of a text is the median over
its windows of ``WINDOW`` symbols or a little more. A document is rejected if it is outside
its language's band, the median of the log perplexities plus or minus ``width`` times
their spread (the median distance from the median). A language with few texts has a
wider band: the spread of all languages is added in proportion to 1 / sqrt(texts).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siegelog.llm.storage import ship, stored
from siegelog.llm.wordhash import hash_spans, windows, words

ORDER = 3
# Code points of Unicode; SYMBOLS ** ORDER is below 2^63.
SYMBOLS = 0x110000
# Symbols of a window of which the median is taken, at least.
WINDOW = 64
# Spreads of all languages that are added to the band of a language with one text.
FEW = 3.0
# Bytes of models in a broadcast, unless one model alone has more.
PACK_BYTES = 64 << 20
# Bytes of texts that are handled at a time, and distinct n-grams that a task gathers.
BATCH_BYTES = 1 << 19
GATHERED = 1 << 20

_CONTINUATION = np.zeros(256, bool)  # later bytes of a character
_CONTINUATION[128:192] = True
_RULE = np.zeros(256, bool)
_RULE[list(b"#*$%&|<>")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts of whole texts; see ``quality_rules``."""
    w = words(texts)
    count = len(texts)
    starts_character = np.concatenate([[0], np.cumsum(~_CONTINUATION[w.data])])
    chars = starts_character[w.ends] - starts_character[w.starts]
    symbols = np.concatenate([[0], np.cumsum(_RULE[w.data])])

    # A line is the bytes between two line feeds; only lines with a word count.
    feeds = np.flatnonzero(w.data == 10)
    line_start = np.concatenate([[0], feeds[:-1] + 1])
    full = np.searchsorted(w.starts, feeds) > np.searchsorted(w.starts, line_start)
    line_start, line_end = line_start[full], feeds[full]
    lines = hash_spans(w.data, line_start, line_end)
    line_of = np.searchsorted(w.begin, line_start, "right") - 1
    order = np.lexsort((lines, line_of))
    same = (lines[order][1:] == lines[order][:-1]) & (line_of[order][1:] == line_of[order][:-1])

    word_of = w.text_of
    threes, at = windows(w.hashes(lower=False), w.first, 3)
    owner = word_of[at]
    by = np.lexsort((threes, owner))
    equal = (threes[by][1:] == threes[by][:-1]) & (owner[by][1:] == owner[by][:-1])
    twice = np.zeros(len(threes), bool)
    twice[by[1:][equal]] = True
    twice[by[:-1][equal]] = True
    covered = np.zeros(len(w.starts) + 3, bool)
    for k in range(3):
        covered[at[twice] + k] = True
    return {
        "n_words": np.diff(w.first),
        "word_chars": np.bincount(word_of, chars, count).astype(np.int64),
        "n_symbols": symbols[w.begin[1:]] - symbols[w.begin[:-1]],
        "n_dup_lines": np.bincount(line_of[order][1:][same], minlength=count),
        "n_repeat_words": np.bincount(word_of, covered[: len(word_of)], count).astype(np.int64),
    }


def grams_of(text: bytes) -> np.ndarray:
    """Numbers of the n-grams that end at each character, after ORDER - 1 blanks."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
    n = len(points)
    s = np.full(n + ORDER - 1, 32, np.int64)
    s[ORDER - 1 :] = np.where((points >= 9) & (points < 14), 32, points)
    code = s[:n].copy()
    for k in range(1, ORDER):
        code *= SYMBOLS
        code += s[k : k + n]
    return code


def _slices(batches, field: str | None = None) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of Arrow batches with some ``BATCH_BYTES`` of texts (or texts of a field of ``row``); null texts are empty."""
    for batch in batches:
        column = batch.column("row").field(field).cast(pa.binary()) if field else batch.column("text")
        start, texts, size = 0, [], 0
        for k in range(batch.num_rows):
            texts.append(column[k].as_py() or b"")
            size += len(texts[-1])
            if size >= BATCH_BYTES or k + 1 == batch.num_rows:
                yield batch.slice(start, len(texts)), texts
                start, texts, size = k + 1, [], 0


def _counted(batches) -> Iterator[pa.RecordBatch]:
    """(lang, n-gram of the highest order, count) of a task's texts."""
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (grams, counts) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(counts)], ["lang", "gram", "count"]
            )
        totals.clear()

    for batch, texts in _slices(batches):
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
            if text:
                by.setdefault(lang, []).append(grams_of(text))
        for lang, parts in by.items():
            grams, counts = np.unique(np.concatenate(parts), return_counts=True)
            if lang in totals:
                both = np.concatenate([totals[lang][0], grams])
                grams, of = np.unique(both, return_inverse=True)
                counts = np.bincount(of, np.concatenate([totals[lang][1], counts])).astype(np.int64)
            totals[lang] = grams, counts
        if sum(len(g) for g, _ in totals.values()) > GATHERED:
            yield from rows()
    yield from rows()


def _discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more."""
    n = [float((counts == k).sum()) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    out = [0.0]
    for k in (1, 2, 3):
        ratio = n[k] / n[k - 1] if n[k - 1] else 0.5
        out.append(min(max(k - (k + 1) * y * ratio, 0.05), k - 0.05))
    return np.array(out)


def kneser_ney(grams: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For each order: the n-grams in order, their probabilities, their contexts in order and those' back-off weights.

    ``grams`` are of the highest order. Lower orders count distinct left
    neighbours; the lowest is interpolated with the uniform distribution, so every
    symbol has a probability after every context.
    """
    levels = []
    for order in range(ORDER, 0, -1):
        levels.append((order, grams, counts))
        grams, counts = np.unique(grams % SYMBOLS ** (order - 1), return_counts=True)
    out: list[tuple[np.ndarray, ...]] = []
    for order, grams, counts in reversed(levels):
        cut = _discounts(counts)[np.minimum(counts, 3)]
        contexts, of = np.unique(grams // SYMBOLS, return_inverse=True)
        total = np.bincount(of, counts)
        backoff = np.bincount(of, cut) / total
        if order == 1:
            lower = np.full(len(grams), 1 / SYMBOLS)
        else:
            shorter, p = out[-1][:2]
            lower = p[np.searchsorted(shorter, grams % SYMBOLS ** (order - 1))]
        probability = (counts - cut) / total[of] + backoff[of] * lower
        out.append((grams, probability, contexts, backoff))
    return out


def _model(rows: pd.DataFrame) -> pd.DataFrame:
    """Arrays by order: n-grams in order, log10 probabilities, contexts in order, log10 back-off weights."""
    by = rows.sort_values("gram")
    body = []
    for grams, probability, contexts, backoff in kneser_ney(by["gram"].to_numpy(), by["count"].to_numpy()):
        values = [grams, np.log10(probability).astype(np.float32), contexts, np.log10(backoff).astype(np.float32)]
        body += [x.tobytes() for x in values]
    return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "bytes": [sum(map(len, body))], "arrays": [body]})


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def gram_log10(grams: np.ndarray, model: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """log10 probability of the last symbol of each n-gram of the highest order after the others."""
    total = np.zeros(len(grams))
    open_ = np.ones(len(grams), bool)
    for order in range(ORDER, 0, -1):
        keys, values, contexts, weights = model[order - 1]
        codes = grams % SYMBOLS**order
        at, found = _find(keys, codes)
        total[open_ & found] += values[at[open_ & found]]
        open_ &= ~found
        at, found = _find(contexts, codes // SYMBOLS)
        total[open_ & found] += weights[at[open_ & found]]
    total[open_] -= np.log10(SYMBOLS)
    return total


class Scorer:
    """Scores texts by the model of their language."""

    def __init__(self, models: dict[str, list[bytes]]) -> None:
        self.models = {}
        for lang, arrays in models.items():
            flat = [np.frombuffer(x, np.float32 if k % 2 else np.int64) for k, x in enumerate(arrays)]
            self.models[lang] = [tuple(flat[k : k + 4]) for k in range(0, len(flat), 4)]

    def log_perplexities(self, lang: str, texts: list[bytes]) -> list[float]:
        """Of texts with a word: the median over windows of log10 of the perplexity per symbol."""
        each = [grams_of(t) for t in texts]
        ends = np.cumsum([len(grams) for grams in each])
        distinct, of = np.unique(np.concatenate(each), return_inverse=True)
        costs = -gram_log10(distinct, self.models[lang])[of]
        out = []
        for own in np.split(costs, ends[:-1]):
            parts = max(1, len(own) // WINDOW)
            cut = np.arange(parts + 1) * len(own) // parts
            out.append(float(np.median(np.add.reduceat(own, cut[:-1]) / np.diff(cut))))
        return out


def _scored(models, field: str | None):
    def run(batches) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models.value)
        for batch, texts in _slices(batches, field):
            out = base_counts(texts)
            scores: list[float | None] = [None] * len(texts)
            by: dict[str, list[int]] = {}
            for k, lang in enumerate(batch.column("lang").to_pylist()):
                if out["n_words"][k]:
                    by.setdefault(lang, []).append(k)
            for lang, members in by.items():
                for k, score in zip(members, scorer.log_perplexities(lang, [texts[k] for k in members]), strict=True):
                    scores[k] = score
            columns = [batch.column("row"), batch.column("lang"), *(pa.array(x, pa.int64()) for x in out.values())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], ["row", "lang", *out, "log_perplexity"])

    return run


def fit_models(rows: DataFrame) -> DataFrame:
    """``lang, bytes, arrays, pack`` of every language of ``rows`` (lang, text)."""
    grams = (
        rows.select("lang", "text")
        .mapInArrow(_counted, "lang string, gram long, count long")
        .groupBy("lang", "gram")
        .agg(F.sum("count").alias("count"))
    )
    fitted = stored(grams.groupBy("lang").applyInPandas(_model, "lang string, bytes long, arrays array<binary>"), "quality-models")
    # one row for each language
    before = F.sum("bytes").over(Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1))
    packs = fitted.select("lang", F.floor(F.coalesce(before, F.lit(0)) / PACK_BYTES).alias("pack"))
    return fitted.join(stored(packs, "quality-packs"), "lang")


def _judged(rows: DataFrame, width: float, field: str | None = None) -> DataFrame:
    """``row``, counts and verdict of each of ``rows`` (row, lang, text); stored, without the text.

    Where ``row`` is a struct with the text in a ``field``, tasks take it from there and get it once.
    """
    spark = rows.sparkSession
    ship(spark)
    models = fit_models(rows)
    packs = [r["pack"] for r in models.select("pack").distinct().orderBy("pack").collect()]
    placed = rows if len(packs) <= 1 else rows.join(models.select("lang", "pack"), "lang", "left")
    schema = T.StructType(
        [
            rows.schema["row"],
            T.StructField("lang", T.StringType()),
            *(T.StructField(name, T.LongType()) for name in COUNTS),
            T.StructField("log_perplexity", T.DoubleType()),
        ]
    )
    scored = None
    for pack in packs or [None]:
        # PACK_BYTES, or one model
        held = {r["lang"]: [bytes(x) for x in r["arrays"]] for r in models.filter(F.col("pack") == pack).collect()} if packs else {}
        own = placed
        if len(packs) > 1:
            here = F.col("pack") == pack
            own = placed.filter(here | F.col("pack").isNull() if pack == packs[0] else here)
        sent = own.select("row", "lang") if field else own.select("row", "lang", "text")
        part = sent.mapInArrow(_scored(spark.sparkContext.broadcast(held), field), schema)
        scored = part if scored is None else scored.unionByName(part)
    scored = stored(scored, "quality")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return _banded(scored.withColumn("base_failed", failed), width)


def _rows(documents: DataFrame, row, text_column: str, language_column: str) -> DataFrame:
    return documents.select(
        row.alias("row"),
        F.col(text_column).cast("binary").alias("text"),
        F.coalesce(F.col(language_column).cast("string"), F.lit("(null)")).alias("lang"),
    )


def quality_rules(
    documents: DataFrame,
    width: float = 6.0,
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str = "lang",
) -> DataFrame:
    """The id, counts, ``base_failed``, ``log_perplexity``, ``perplexity_failed`` and ``kept`` for each row.

    ``n_words`` words (runs of other than white space) with ``word_chars`` code
    points; ``n_symbols`` of ``#*$%&|<>``; ``n_dup_lines`` lines with a word equal to
    an earlier line; ``n_repeat_words`` words in 3-word windows found twice or more.
    ``base_failed``: fewer than 50 words, or over half of them repeat. ``log_perplexity``
    is the median over windows of log10 of the perplexity per symbol; a
    row without words has none and has failed the base rule. A null text is empty, a
    null language is one of its own. Repeated rows count as often as they come.
    """
    rows = _rows(documents, F.col(id_column).cast("long"), text_column, language_column)
    return _judged(rows, width).drop("lang").withColumnRenamed("row", id_column)


def kept_rows(documents: DataFrame, width: float = 6.0, text_column: str = "text", language_column: str = "lang") -> DataFrame:
    """The rows of ``documents`` that ``quality_rules`` keeps, each judged by itself, with all their columns.

    Rows pass through the scoring and are filtered as they were stored with it, so no
    text is shuffled or joined.
    """
    plain = isinstance(documents.schema[text_column].dataType, (T.StringType, T.BinaryType))
    rows = _rows(documents, F.struct("*"), text_column, language_column)
    judged = _judged(rows, width, text_column if plain else None)
    return judged.filter("kept").select("row.*")


def _banded(scored: DataFrame, width: float) -> DataFrame:
    """Bands by language, from the texts that pass the base rule."""
    passed = scored.filter(~F.col("base_failed")).select("lang", "log_perplexity")
    middle = passed.groupBy("lang").agg(
        F.percentile_approx("log_perplexity", 0.5, 100_000).alias("middle"), F.count("*").alias("texts")
    )
    middle = stored(middle, "quality-middle")
    spread = (
        passed.join(middle, "lang")
        .groupBy("lang")
        .agg(F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("middle")), 0.5, 100_000).alias("spread"))
    )
    bands = middle.join(spread, "lang")
    # one row for each language
    every = Window.partitionBy()
    pooled = F.sum(F.col("texts") * F.col("spread")).over(every) / F.sum("texts").over(every)
    reach = F.lit(width) * (F.col("spread") + F.lit(FEW) * pooled / F.sqrt("texts"))
    bands = bands.select("lang", (F.col("middle") - reach).alias("lower"), (F.col("middle") + reach).alias("upper"))
    # stored, so that the planner knows its size and leaves the scored rows where they are
    bands = stored(bands, "quality-bands")
    outside = ~F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    return (
        scored.join(bands, "lang", "left")
        .withColumn("perplexity_failed", F.coalesce(outside, F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("perplexity_failed"))
        .drop("lower", "upper")
    )
