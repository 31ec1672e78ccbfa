"""FM-index over sequences of word numbers: backward search on a wavelet matrix."""

from __future__ import annotations

import numpy as np


class Ranks:
    """A bit vector with constant-time rank: packed words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]])
        self.zeros = len(bits) - int(ones.sum())

    def ones(self, places: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = places >> 6
        low = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Rank of any symbol below any place, one bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.levels = []
        codes = np.arange(size)
        start = np.zeros(size, np.int64)
        for level in reversed(range(self.depth)):
            bits = (symbols >> level) & 1
            ranks = Ranks(bits.astype(np.uint8))
            self.levels.append((level, ranks))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
            ones = ranks.ones(start)
            start = np.where((codes >> level) & 1 == 1, ranks.zeros + ones, start - ones)
        self.start = start

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        at = places
        for level, ranks in self.levels:
            ones = ranks.ones(at)
            at = np.where((symbols >> level) & 1 == 1, ranks.zeros + ones, at - ones)
        return at - self.start[symbols]


class FMIndex:
    """Index of a text of symbols from 1 (0 separates passages) for patterns of up to ``length``
    symbols. Suffixes are sorted by their first ``length`` symbols, which is all that searches of such
    patterns ask for."""

    def __init__(self, text: np.ndarray, length: int):
        size = int(text.max()) + 1
        self.text = text
        self.order = np.argsort(_ranks(text, length), kind="stable")
        self.matrix = WaveletMatrix(text[self.order - 1], size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns with one more symbol in front."""
        base = self.first[symbols]
        both = self.matrix.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        return base + both[: len(symbols)], base + both[len(symbols) :]

    def repeated(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows of ``length`` symbols of the text itself that begin at ``starts``: those that
        occur more than once, as (places in ``starts``, range from, range to). A window that is down to
        one suffix is the only one of its kind and leaves the search."""
        alive = np.arange(len(starts))
        last = self.text[starts + length - 1]
        low, high = self.first[last], self.first[last + 1]
        for step in range(length - 2, -1, -1):
            more = high - low > 1
            alive, low, high = alive[more], low[more], high[more]
            low, high = self.extend(self.text[starts[alive] + step], low, high)
        more = high - low > 1
        return alive[more], low[more], high[more]


def _ranks(text: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the suffixes by their first ``length`` symbols."""
    ranks, have = text.astype(np.int64), 1
    while have < length:
        step = min(have, length - have)
        behind = np.zeros_like(ranks)
        behind[:-step] = ranks[step:] if step < len(ranks) else 0
        _, ranks = np.unique(ranks * (int(ranks.max()) + 1) + behind, return_inverse=True)
        have += step
    return ranks
