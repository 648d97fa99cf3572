"""An FM-index over integer symbols: suffix array, wavelet matrix, backward search and sampled locate, in numpy.

All operations take arrays, so many phrases are searched at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes of ``symbols`` in order; zeros are separators, each smaller than the ones before it and unique.

    Ranks are doubled until all differ; since separators differ, that takes no more rounds than the logarithm of the
    longest run between two of them.
    """
    n = len(symbols)
    walls = symbols == 0
    rank = symbols.astype(np.int64) + n
    rank[walls] = np.arange(int(walls.sum()))[::-1]
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        changed = np.ones(n, np.int64)
        if width == 1:
            changed[1:] = rank[order[1:]] != rank[order[:-1]]
        else:
            changed[1:] = keys[order[1:]] != keys[order[:-1]]
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(changed) - 1
        if n == 0 or dense[order[-1]] == n - 1:
            return order
        second = np.zeros(n, np.int64)
        second[: n - width] = dense[width:] + 1
        keys = dense * (n + 1) + second
        order = np.argsort(keys, kind="stable")
        width *= 2


class WaveletMatrix:
    """Ranks and values of a sequence of symbols below ``2**levels``."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.ones, self.zeros, self.bits = levels, [], [], []
        current = symbols.astype(np.int64)
        for level in range(levels - 1, -1, -1):
            bit = ((current >> level) & 1).astype(np.int32)
            before = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=before[1:])
            self.ones.append(before)
            self.bits.append(bit)
            self.zeros.append(len(bit) - int(before[-1]))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, high = np.zeros(len(symbol), np.int64), position.astype(np.int64)
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = self.ones[k][low], self.ones[k][high]
            low = np.where(one, self.zeros[k] + a, low - a)
            high = np.where(one, self.zeros[k] + b, high - b)
        return high - low

    def access_rank(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it stands before it."""
        value, low, at = np.zeros(len(position), np.int64), np.zeros(len(position), np.int64), position.astype(np.int64)
        for k in range(self.levels):
            one = self.bits[k][at].astype(bool)
            a, b = self.ones[k][low], self.ones[k][at]
            value = value * 2 + one
            low = np.where(one, self.zeros[k] + a, low - a)
            at = np.where(one, self.zeros[k] + b, at - b)
        return value, at - low


class FmIndex:
    """Full-text index of runs of symbols from 1 to ``alphabet``, separated by zeros.

    A suffix position is kept for every ``sample``-th place and for each place after a separator, so that locating an
    occurrence never steps across a separator.
    """

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = 8):
        n = len(symbols)
        order = suffix_array(symbols)
        last = symbols[order - 1]
        self.first = np.zeros(alphabet + 2, np.int64)
        np.cumsum(np.bincount(symbols, minlength=alphabet + 1), out=self.first[1:])
        self.matrix = WaveletMatrix(last, max(1, int(alphabet).bit_length()))
        self.size = n
        kept = (order % sample == 0) | (last == 0)
        self.kept, self.kept_before = kept, np.concatenate([[0], np.cumsum(kept)])
        self.places = order[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases of one length, one per row."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            low[alive] = self.first[symbol] + self.matrix.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.matrix.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_rows = np.arange(len(rows))
        while len(open_rows):
            done = self.kept[at[open_rows]]
            ready = open_rows[done]
            out[ready] = self.places[self.kept_before[at[ready]]] + steps[ready]
            open_rows = open_rows[~done]
            symbol, before = self.matrix.access_rank(at[open_rows])
            at[open_rows] = self.first[symbol] + before
            steps[open_rows] += 1
        return out
