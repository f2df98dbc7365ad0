"""Elias-Fano coded monotone sequences in one memory-mapped file."""

from __future__ import annotations

import tempfile

import numpy as np

_STEP = 1 << 16  # queries that are answered at a time


class Levels:
    """Arrays written one after the other to a file of this task, then mapped. The file has no name and goes with the task."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()
        self.at: dict[str, tuple[int, np.dtype, int]] = {}

    def put(self, name: str, array: np.ndarray) -> None:
        pad = -self.file.tell() % 8
        self.file.write(b"\0" * pad)
        self.at[name] = (self.file.tell(), array.dtype, len(array))
        self.file.write(np.ascontiguousarray(array).tobytes())

    def get(self, name: str) -> np.ndarray:
        offset, dtype, n = self.at[name]
        self.file.flush()
        return np.memmap(self.file, dtype, "r", offset, n) if n else np.zeros(0, dtype)


class EliasFano:
    """A sequence of n sorted numbers below ``universe``: about 2 + log2(universe / n) bits for each.

    The low bits lie side by side; the high parts are unary in a bitmap, which has a
    count of ones for each 64-bit word.
    """

    def __init__(self, levels: Levels, name: str, values: np.ndarray, universe: int) -> None:
        values = values.astype(np.uint64)
        self.n = len(values)
        self.shift = max(0, (max(1, universe) // max(1, self.n)).bit_length() - 1)
        self.levels, self.name = levels, name
        s = np.uint64(self.shift)
        high = values >> s
        self.tops = int(universe >> self.shift) + 1
        bits = np.zeros((self.n + self.tops + 64) // 64 * 64, np.uint8)
        bits[(high + np.arange(self.n, dtype=np.uint64)).astype(np.int64)] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        low = np.zeros(self.n * self.shift // 64 + 2, np.uint64)
        if self.shift:
            place = np.arange(self.n, dtype=np.uint64) * s
            word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            part = values & ((np.uint64(1) << s) - np.uint64(1))
            np.bitwise_or.at(low, word, part << bit)
            over = bit + s > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - bit[over]))
        for key, array in (("high", words), ("ones", ones), ("low", low)):
            levels.put(f"{name}.{key}", array)

    def open(self) -> EliasFano:
        self.high, self.ones, self.low = (self.levels.get(f"{self.name}.{k}") for k in ("high", "ones", "low"))
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        return self

    def _in_word(self, words: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place of the set bit with so many set bits before it in its word."""
        bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return np.argmax(np.cumsum(bits, axis=1, dtype=np.uint8) > rank.astype(np.uint8)[:, None], axis=1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the zero with number k; -1 for k = -1."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        word = np.clip(word, 0, len(self.high) - 1)
        at = word * 64 + self._in_word(~self.high[word], np.maximum(k - self.zeros[word], 0))
        return np.where(k < 0, -1, at)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.shift:
            return np.zeros(len(i), np.uint64)
        s = np.uint64(self.shift)
        place = i.astype(np.uint64) * s
        word, bit = (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
        first = self.low[word] >> bit
        second = np.where(bit > 0, self.low[word + 1] << ((np.uint64(64) - bit) & np.uint64(63)), np.uint64(0))
        return (first | second) & ((np.uint64(1) << s) - np.uint64(1))

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.uint64)
        for k in range(0, len(i), _STEP):
            part = i[k : k + _STEP]
            word = np.searchsorted(self.ones, part, "right") - 1
            at = word * 64 + self._in_word(np.asarray(self.high[word]), part - self.ones[word])
            out[k : k + _STEP] = ((at - part).astype(np.uint64) << np.uint64(self.shift)) | self._low(part)
        return out

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first number not below x; n if there is none."""
        out = np.empty(len(x), np.int64)
        for k in range(0, len(x), _STEP):
            part = x[k : k + _STEP]
            top = (part >> np.uint64(self.shift)).astype(np.int64)
            begin, end = self._zero(top - 1) + 1 - top, self._zero(top) - top
            low = part & ((np.uint64(1) << np.uint64(self.shift)) - np.uint64(1))
            while (open_ := begin < end).any():
                middle = (begin + end) // 2
                below = np.zeros(len(part), bool)
                below[open_] = self._low(middle[open_]) < low[open_]
                begin = np.where(open_ & below, middle + 1, begin)
                end = np.where(open_ & ~below, middle, end)
            out[k : k + _STEP] = begin
        return out

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of x, or -1."""
        if not self.n or not len(x):
            return np.full(len(x), -1)
        at = self.successor(x)
        there = np.minimum(at, self.n - 1)
        return np.where((at < self.n) & (self.access(there) == x), there, -1)
