"""FM-index over a sequence of small integers, with batched backward search, in numpy.

The Burrows-Wheeler transform is kept in a wavelet matrix (one bit plane per bit of the alphabet, with
prefix counts), ranks of many (symbol, position) pairs are answered at once, and positions are located
by walking to the nearest of the sampled suffixes.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling, from three symbols on; only suffixes not yet told apart are sorted again."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate((text + 1, [0, 0])).astype(np.int64)
    base = int(padded.max()) + 1
    key = (padded[:n] * base + padded[1 : n + 1]) * base + padded[2:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # per place in the order: where its group begins
    rank = np.empty(n, np.int64)
    rank[order] = start
    step = 3
    while True:
        at = np.flatnonzero(~new | ~np.append(new[1:], True))
        if not len(at):
            return order
        rows, group = order[at], start[at]
        ahead = rows + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        again = np.lexsort((second, group))
        rows, second = rows[again], second[again]
        apart = np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
        order[at], new[at] = rows, apart
        start[at] = np.maximum.accumulate(np.where(apart, at, 0))
        rank[rows] = start[at]
        step *= 2


class WaveletMatrix:
    def __init__(self, values: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        current = values.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            plane = (current >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(plane, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(len(plane) - plane.sum()))
            current = np.concatenate((current[plane == 0], current[plane == 1]))

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        low, high = np.zeros_like(position), position.copy()
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            up = ((symbol >> b) & 1).astype(bool)
            a, z = ones[low], ones[high]
            low = np.where(up, zeros + a, low - a)
            high = np.where(up, zeros + z, high - z)
        return high - low

    def access(self, position: np.ndarray) -> np.ndarray:
        """Symbols at the positions."""
        out = np.zeros_like(position)
        at = position.copy()
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            bit = ones[at + 1] - ones[at]
            out = (out << 1) | bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Symbols must be positive; 0 is added as the end of the text."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        text = np.concatenate((np.asarray(text, np.int64), [0]))
        order = suffix_array(text)
        bwt = text[order - 1]
        self.size = len(text)
        self.matrix = WaveletMatrix(bwt, sigma)
        counts = np.bincount(text, minlength=sigma + 1)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        marked = order % sample == 0
        self.marked = marked
        self.mark_rank = np.concatenate(([0], np.cumsum(marked)))
        self.sampled = order[marked]

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of equally long phrases (one row each), by backward search."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[:, column]
            start = self.before[symbol]
            low = start + self.matrix.rank(symbol, low)
            high = start + self.matrix.rank(symbol, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        rows = rows.astype(np.int64).copy()
        steps = np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.marked[rows])
        while len(open_):
            at = rows[open_]
            symbol = self.matrix.access(at)
            rows[open_] = self.before[symbol] + self.matrix.rank(symbol, at)
            steps[open_] += 1
            open_ = open_[~self.marked[rows[open_]]]
        return (self.sampled[self.mark_rank[rows]] + steps) % self.size
