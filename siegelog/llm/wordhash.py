"""Words of many texts at once as arrays of offsets and 64-bit hashes.

A word is a run of bytes other than space and the controls 9 to 13. Texts are
UTF-8 bytes. Memory is a few bytes for each byte of text and some 60 for each word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

# Bytes of a span beyond which it is hashed by itself.
LONG = 1024
# Bytes of texts in a batch; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20

_FACTOR = 0x9E3779B97F4A7C15

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each bit depends on all (a shift-multiply finaliser)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans ``data[starts:ends]``.

    Eight bytes at a time, each followed by the finaliser: spans of up to eight bytes
    differ whenever they or their lengths do (but for chance between lengths), longer ones
    by chance of 2^-64. Spans over ``LONG`` bytes take a digest of the same length.
    """
    sizes = (ends - starts).astype(np.int64)
    out = mix(sizes.astype(np.uint64) * np.uint64(_FACTOR) + np.uint64(1))
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    at = np.flatnonzero((sizes > 0) & (sizes <= LONG))
    place, left = starts[at].astype(np.int64), sizes[at]
    while len(at):
        value = eights[place]
        short = np.flatnonzero(left < 8)
        value[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        out[at] = mix((out[at] ^ value) * np.uint64(_FACTOR))
        more = np.flatnonzero(left > 8)
        at, place, left = at[more], place[more] + 8, left[more] - 8
    for k in np.flatnonzero(sizes > LONG):
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


@dataclass
class Words:
    """Words of texts; ``first[d]:first[d + 1]`` are those of text d."""

    data: np.ndarray  # the texts' bytes, a line feed after each
    begin: np.ndarray  # of each text, and the end of all
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, lower: bool) -> np.ndarray:
        """Of each word; ``lower`` folds A-Z only."""
        return hash_spans(_LOWER[self.data] if lower else self.data, self.starts, self.ends)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(texts: list[bytes]) -> Words:
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=begin[1:])
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    return Words(data, begin, starts, ends, np.searchsorted(starts, begin))


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words, and where each begins (an index of a word)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out = out * np.uint64(_FACTOR) + hashes[k : n + k]
    last = np.zeros(len(hashes), bool)  # windows that begin here reach into the next text
    for end in np.unique(first[1:]):
        last[max(0, end - size + 1) : end] = True
    at = np.flatnonzero(~last[:n])
    return mix(out[at]), at


def batches(rows: Iterator[tuple], limit: int = BATCH_BYTES) -> Iterator[list[tuple]]:
    """Rows (key, text) in lists of about ``limit`` bytes of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def text_batches(arrow_batches, key: str, text: str, limit: int = BATCH_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """(keys, texts as bytes) of Arrow batches, a few MB at a time; null texts are empty."""

    def rows() -> Iterator[tuple]:
        for batch in arrow_batches:
            for i, body in zip(batch.column(key).to_pylist(), batch.column(text), strict=True):
                yield i, (body.as_py() or b"")

    for held in batches(rows(), limit):
        yield [x[0] for x in held], [x[1] for x in held]
