"""Compressed full-text index of one shard: a Burrows-Wheeler transform in a wavelet matrix, searched backwards."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """A sequence of symbols below 2**levels as one packed bit vector a level, each with a directory of its ranks."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n, self.levels = len(symbols), levels
        self.words, self.ones, self.zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1 == 1
            packed = np.packbits(np.concatenate([bit, np.zeros(64 + -len(bit) % 64, bool)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        every = np.arange(1 << levels)
        self.first = self._down(every, np.zeros(len(every), np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first `at` places lead on the last level, as far as they hold `symbol`."""
        for i in range(self.levels):
            word = at >> 6
            ones = self.ones[i][word] + np.bitwise_count(self.words[i][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> (self.levels - 1 - i)) & 1 == 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the first `at` places."""
        return self._down(symbol, at) - self.first[symbol]


class FMIndex:
    """Index of strings of symbols 1, 2, ... that each carry an id; answers backward searches of up to `depth` symbols.

    Places are sorted by the `depth` symbols that start there (prefix doubling), which is all that patterns of that length
    ask for: two places that agree so far may stand either way. Symbol 0 parts the strings, and no pattern holds it.
    """

    def __init__(self, strings: np.ndarray, sizes: np.ndarray, ids: np.ndarray, depth: int):
        n = len(strings) + len(sizes)
        ends = np.cumsum(sizes + 1)
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        text[inside] = strings
        top = int(text.max(initial=0)) + 1
        order, rank, have = np.argsort(text, kind="stable"), text, 1
        while have < depth:
            key = np.zeros(n, np.int64)
            key[: n - have] = rank[have:]
            key += rank * (int(rank.max(initial=0)) + 1)
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], (np.diff(key[order]) != 0).astype(np.int64)])) + 1
            have *= 2
        self.n = n
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top))])  # places that start with a lesser symbol
        self.wavelet = WaveletMatrix(text[order - 1], max(1, (top - 1).bit_length()))
        self.ids = np.repeat(ids, sizes + 1)[order]

    def search(self, symbols: np.ndarray, ends: np.ndarray, depth: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(matched, low, high) for each place of `symbols` in `ends`: how many symbols that end there, up to `depth`, stand
        at `least` places or more of the index, and the range of these places. All places step back together."""
        c = symbols[ends]
        low, high = self.before[c].copy(), self.before[c + 1].copy()
        matched = (high - low >= least).astype(np.int64)
        alive = np.flatnonzero(matched)
        for back in range(1, depth):
            c = symbols[ends[alive] - back]
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([low[alive], high[alive]])) + np.concatenate([self.before[c]] * 2)
            a, b = both[: len(c)], both[len(c) :]
            good = b - a >= least
            alive, a, b = alive[good], a[good], b[good]
            low[alive], high[alive] = a, b
            matched[alive] += 1
        return matched, low, high

    def least_ids(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least id of the places low..high-1 of each range (none is empty); ranges are equal or apart."""
        start, which = np.unique(low, return_inverse=True)
        end = np.empty(len(start), np.int64)
        end[which] = high
        cuts = np.column_stack([start, end]).reshape(-1)
        values = np.append(self.ids, np.iinfo(np.int64).max)  # so that a range may reach the end
        return np.minimum.reduceat(values, cuts)[::2][which] if len(cuts) else np.zeros(0, np.int64)
