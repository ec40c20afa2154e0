"""Elias-Fano sequences with vectorised access, and a two-level n-gram trie on them."""

from __future__ import annotations

import tempfile

import numpy as np

U = np.uint64


def _pack(bits: np.ndarray) -> np.ndarray:
    """Little-endian bits as 64-bit words, with a spare word."""
    data = np.packbits(bits, bitorder="little")
    out = np.zeros((len(data) + 7) // 8 + 1, U)
    out.view(np.uint8)[: len(data)] = data
    return out


def _select(words: np.ndarray, before: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Position of the i-th set bit; before: set bits ahead of each word."""
    at = np.searchsorted(before, i, "right") - 1
    word, left = words[at].copy(), i - before[at]
    place = np.zeros(len(i), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(word & U((1 << width) - 1)).astype(np.int64)
        over = left >= low
        left = np.where(over, left - low, left)
        place += np.where(over, width, 0)
        word = np.where(over, word >> U(width), word)
    return at * 64 + place


class EliasFano:
    """A monotone sequence of integers below ``bound``."""

    PARTS = ("low", "high", "ones", "zeros")

    def __init__(self, values: np.ndarray, bound: int):
        n = self.n = len(values)
        self.bound = max(int(bound), 1)
        self.bits = max(0, (self.bound // max(n, 1)).bit_length() - 1)
        v = np.asarray(values, U)
        cells = np.zeros((n, self.bits), bool)
        for k in range(self.bits):
            cells[:, k] = (v >> U(k)) & U(1)
        self.low = _pack(cells.ravel()) if self.bits else np.zeros(2, U)
        self.buckets = (self.bound >> self.bits) + 1
        marks = np.zeros(n + self.buckets + 1, bool)
        marks[(v >> U(self.bits)).astype(np.int64) + np.arange(n)] = True
        self.high = _pack(marks)
        count = np.bitwise_count(self.high).astype(np.int64)
        self.ones = np.cumsum(count) - count
        self.zeros = np.cumsum(64 - count) - (64 - count)

    def lower(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(U)
        x = self.low[word] >> shift
        rest = np.where(shift > 0, self.low[np.minimum(word + 1, len(self.low) - 1)] << ((U(64) - shift) & U(63)), U(0))
        return ((x | rest) & U((1 << self.bits) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((_select(self.high, self.ones, i) - i) << self.bits) | self.lower(i)

    def bucket(self, b: np.ndarray) -> np.ndarray:
        """Index of the first value whose high part is b or more."""
        out = np.zeros(len(b), np.int64)
        some = b > 0
        if some.any():
            out[some] = _select(~self.high, self.zeros, b[some] - 1) + 1 - b[some]
        return out

    def successor(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """First index in [begin, end) whose value is x or more; end if there is none."""
        b = x >> self.bits
        low = np.clip(self.bucket(b), begin, end)
        top = np.clip(self.bucket(b + 1), begin, end)
        want = x & ((1 << self.bits) - 1)
        while True:
            open_ = np.flatnonzero(low < top)
            if not len(open_):
                return low
            mid = (low[open_] + top[open_]) >> 1
            less = self.lower(mid) < want[open_]
            low[open_[less]] = mid[less] + 1
            top[open_[~less]] = mid[~less]

    def mapped(self, file) -> EliasFano:
        """The same sequence with its arrays in a file mapped into memory."""
        for part in self.PARTS:
            setattr(self, part, mapped(getattr(self, part), file))
        return self


def mapped(array: np.ndarray, file) -> np.ndarray:
    at = file.seek(0, 2)
    at = file.seek(-(-at // 16) * 16)
    file.write(np.ascontiguousarray(array).tobytes())
    file.flush()
    return np.memmap(file, array.dtype, "r", at, array.shape) if array.size else array


class Trie:
    """Quantised log probabilities of (context, word) pairs.

    Level 1 holds the contexts, a pointer for each to its words in level 2, where words
    are kept relative to their context (context number * vocabulary + word), so that the
    whole level is one monotone sequence.  Codes are 12 bits wide, in a codebook of means.
    """

    CODES = 4096

    def __init__(self, context: np.ndarray, word: np.ndarray, logp: np.ndarray, vocabulary: int):
        self.file = tempfile.TemporaryFile(prefix="quirework-trie-")
        self.vocabulary = vocabulary
        names, first = np.unique(context, return_index=True)
        self.contexts = EliasFano(names, vocabulary).mapped(self.file)
        self.pointers = EliasFano(np.append(first, len(context)), len(context) + 1).mapped(self.file)
        number = np.repeat(np.arange(len(names)), np.diff(np.append(first, len(context))))
        self.words = EliasFano(number * vocabulary + word, max(1, len(names)) * vocabulary).mapped(self.file)
        least = logp.min(initial=0.0)
        step = max((logp.max(initial=least) - least) / (self.CODES - 1), 1e-12)
        code = np.rint((logp - least) / step).astype(np.uint16)
        size = np.bincount(code, minlength=1)
        self.book = np.bincount(code, weights=logp, minlength=1) / np.maximum(size, 1)
        self.codes = mapped(code, self.file)

    def lookup(self, context: np.ndarray, word: np.ndarray, at_once: int = 200_000) -> np.ndarray:
        """Log probability of each pair, nan where the trie lacks it; in slices, to bound what a search holds."""
        parts = [self._lookup(context[k : k + at_once], word[k : k + at_once]) for k in range(0, len(context), at_once)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.full(len(context), np.nan)
        if not self.contexts.n or not len(context):
            return out
        zero = np.zeros(len(context), np.int64)
        at = self.contexts.successor(context, zero, zero + self.contexts.n)
        have = np.flatnonzero(at < self.contexts.n)
        have = have[self.contexts.get(at[have]) == context[have]]
        at = at[have]
        begin, end = self.pointers.get(at), self.pointers.get(at + 1)
        want = at * self.vocabulary + word[have]
        i = self.words.successor(want, begin, end)
        hit = np.flatnonzero(i < end)
        hit = hit[self.words.get(i[hit]) == want[hit]]
        out[have[hit]] = self.book[self.codes[i[hit]]]
        return out

    def close(self) -> None:
        self.file.close()
