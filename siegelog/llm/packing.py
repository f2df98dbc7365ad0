"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces of the lengths in the binary notation of
n, none over ``length``, longest first. A piece is a whole sequence: no
sequence crosses documents and none needs padding. ``bucket`` is the length, so
that a trainer draws batches of equal lengths.

Tokens are those that the tokenizer gives for the whole text. The tokenizer's rules
never reach across white space, so a text is cut into units there, and, for plain
Latin words, between letters, digits and other signs as its pattern does; each
distinct unit, told apart by its bytes, is encoded once by a Python worker.
``tests/llm/test_text_operators.py`` compares with whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siegelog.llm.storage import ship
from siegelog.llm.wordhash import _LOWER, _SPACE, text_batches, words

END = 2
# Encoded units that a Python worker keeps (some 200 bytes each); then it starts anew.
KEPT_UNITS = 300_000
# Documents whose tokens are put together at a time.
GROUP = 256
# Pieces in a batch of results, and bytes of their tokens; a document's pieces are in one batch.
ROWS = 2000
ROWS_BYTES = 1 << 20

# Classes of bytes: white space, letter, digit, other, and bytes whose word is encoded as a whole.
_BLANK, _LETTER, _DIGIT, _OTHER, _WHOLE = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[_SPACE] = _BLANK
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[128:] = _CLASS[ord("'")] = _CLASS[ord("<")] = _WHOLE
_CLASS[:9] = _CLASS[14:32] = _CLASS[127] = _WHOLE

def _byte_names() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


_NAMES = _byte_names()


def _classes(data: np.ndarray) -> np.ndarray:
    """Classes of bytes; the Latin letters U+00C0 to U+017F, whose lower case is one letter, are letters."""
    kind = _CLASS[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5))
    follow = data[lead + 1]
    sign = (data[lead] == 0xC3) & ((follow == 0x97) | (follow == 0xB7))  # the signs for times and divided by
    dotted = (data[lead] == 0xC4) & (follow == 0xB0)  # its lower case is two characters
    lead = lead[~sign & ~dotted]
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


class Encoder:
    """Token ids of texts, each distinct unit encoded once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.begin = np.zeros(1, np.int64)  # in ids, by number of the unit

    def _unit(self, unit: bytes, plain: bool) -> list[int]:
        """``plain``: one piece of the tokenizer's pattern, for which only case matters."""
        if not plain:
            return self.tokenizer.encode(unit.decode("utf-8", "replace"), add_special_tokens=False).ids
        piece = unit.decode().lower()
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(_NAMES)
        return [t.id for t in self.tokenizer.model.tokenize(piece)]

    def _units(self, texts: list[bytes]):
        """Distinct units, whether they are plain, the code of each unit, and the first unit of each text."""
        w = words(texts)
        if not len(w.starts):
            return [], np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        kind = _classes(w.data)
        whole = np.logical_or.reduceat(kind == _WHOLE, w.starts)  # up to the next word: white space adds nothing
        cover = np.zeros(len(kind) + 1, np.int8)
        cover[w.starts[whole]] = 1
        cover[w.ends[whole]] = -1
        inside = np.cumsum(cover[:-1], dtype=np.int8).view(bool)
        change = np.ones(len(kind), bool)
        change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        change &= ~inside
        change[w.starts] = True
        starts = np.flatnonzero(change & (kind != _BLANK))
        of = np.searchsorted(w.starts, starts, "right") - 1
        ends = np.minimum(np.append(starts[1:], len(kind)), w.ends[of])
        data = np.where(inside, w.data, _LOWER[w.data])  # case may matter in a unit that is encoded as a whole
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[kind != _BLANK])]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
        code = coded.indices.to_numpy()
        plain = np.zeros(len(coded.dictionary), bool)
        plain[code] = ~whole[of]
        return coded.dictionary.to_pylist(), plain, code, np.searchsorted(starts, w.begin)

    def _learn(self, new: list[tuple[bytes, bool]]) -> None:
        units = [self._unit(unit, plain) for unit, plain in new]
        known = len(self.known)
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in units for i in x), np.int32)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(x) for x in units], dtype=np.int64)])
        self.known.update((unit, known + k) for k, (unit, _) in enumerate(new))

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text, END last."""
        if len(self.known) > KEPT_UNITS:
            self.clear()
        units, plain, code, first = self._units(texts)
        new = [(u, p) for u, p in zip(units, plain.tolist(), strict=True) if u not in self.known]
        if new:
            self._learn(new)
        unit = np.array([self.known[u] for u in units], np.int64)[code]
        for g in range(0, len(texts), GROUP):
            bounds = first[g : g + GROUP + 1]
            own = unit[bounds[0] : bounds[-1]]
            start, size = self.begin[own], self.begin[own + 1] - self.begin[own]
            total = np.concatenate([[0], np.cumsum(size)])
            ids = self.ids[np.arange(total[-1]) + np.repeat(start - total[:-1], size)]
            cuts = total[bounds - bounds[0]]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield np.append(ids[a:b], np.int32(END))


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """Kept by a Python worker from task to task."""
    return Encoder(path)


def piece_lengths(n: int, longest: int) -> list[int]:
    """n as a sum of powers of two, none over ``longest``, which is one itself; longest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _packed(tokenizer: str, longest: int):
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket"]
    types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        context = TaskContext.get()
        sequence = context.partitionId() << 33 if context else 0
        for doc_ids, texts in text_batches(batches, "id", "text"):
            rows: list[tuple] = []
            held = 0
            for doc_id, ids in zip(doc_ids, _encoder(tokenizer).encode(texts), strict=True):
                start, body = 0, ids.astype("<u4").tobytes()
                for size in piece_lengths(len(ids), longest):
                    rows.append((doc_id, start, size, body[4 * start : 4 * (start + size)], len(ids), sequence, 0, size))
                    start, sequence = start + size, sequence + 1
                held += len(body)
                if len(rows) >= ROWS or held >= ROWS_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    return run


def pack_documents(
    documents: DataFrame, tokenizer: str, longest: int = 4096, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row for each piece: its place in the document, its tokens, and its sequence.

    ``start`` counts the document's tokens before it, ``ids`` holds ``length`` tokens as
    little-endian unsigned 32-bit numbers, ``doc_tokens`` counts the document's tokens
    with the closing id 2. ``sequence_id`` is unique and follows the input's partitions;
    ``offset`` is 0, as a piece fills its sequence; ``bucket`` is the sequence's length.
    A null or empty text is one piece with the closing id; rows that share an id are
    packed each for itself, also those with a null id.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    ship(documents.sparkSession)
    rows = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("binary").alias("text"))
    schema = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bucket long"
    return rows.mapInArrow(_packed(tokenizer, longest), schema).withColumnRenamed("id", id_column)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum instead of their tokens."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
