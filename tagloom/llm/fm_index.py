"""An FM-index over a string of integers, with numpy: all queries of a step are answered together."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank queries on a string of symbols 0..n_symbols-1; one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = list(range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1))
        self.words, self.before, self.zeros = [], [], []
        row = symbols
        for level in self.levels:
            bit = (row >> level) & 1
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        every = np.arange(n_symbols)
        self.first = self._walk(every, np.zeros(n_symbols, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, words, before, zeros in zip(self.levels, self.words, self.before, self.zeros, strict=True):
            low = words[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = before[at >> 6] + np.bitwise_count(low)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._walk(symbol, at) - self.first[symbol]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        steps = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
        rank = np.empty(n, np.int64)
        rank[order] = steps
        if not n or steps[-1] == n - 1:
            return order
        width *= 2


class FmIndex:
    """Counts and locates patterns in ``s`` (integers from 1), which may hold separators that no pattern has.

    Every ``sample``-th position of the string keeps its place in suffix order; other places are
    found by walking back through the string to such a position.
    """

    def __init__(self, s: np.ndarray, sample: int = 16):
        self.alphabet = np.unique(s)
        text = np.concatenate([np.searchsorted(self.alphabet, s) + 1, [0]])  # 0 ends the string
        order = suffix_array(text)
        bwt = text[order - 1]
        self.bwt, self.n_symbols = bwt, len(self.alphabet) + 1
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.n_symbols))])
        self.matrix = WaveletMatrix(bwt, self.n_symbols)
        self.sampled = order % sample == 0
        self.sample_at = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: for each row of ``patterns``, its range [low, high) in suffix order."""
        at = np.minimum(np.searchsorted(self.alphabet, patterns), max(0, len(self.alphabet) - 1))
        known = (self.alphabet[at] == patterns).all(1) if len(self.alphabet) else np.zeros(len(patterns), bool)
        low, high = np.zeros(len(patterns), np.int64), np.zeros(len(patterns), np.int64)
        live = np.flatnonzero(known)
        codes = at[live] + 1
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(self.bwt), np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = codes[:, k]
            lo, hi = self.less[c] + self.matrix.rank(c, lo), self.less[c] + self.matrix.rank(c, hi)
            go = lo < hi
            live, codes, lo, hi = live[go], codes[go], lo[go], hi[go]
        low[live], high[live] = lo, hi
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All occurrences of the given ranges: which range, and the position in the string."""
        counts = high - low
        which = np.repeat(np.arange(len(low)), counts)
        row = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + low[which]
        place = np.empty(len(row), np.int64)
        left, steps = np.arange(len(row)), 0
        while len(left):
            done = self.sampled[row]
            place[left[done]] = self.samples[self.sample_at[row[done]]] + steps
            left, row = left[~done], row[~done]
            c = self.bwt[row]
            row = self.less[c] + self.matrix.rank(c, row)
            steps += 1
        return which, place
