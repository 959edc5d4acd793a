"""An FM-index over sequences of word numbers: suffix order, wavelet-tree ranks and sampled suffix positions, in NumPy.

The text of an index is a list of runs of symbols 1, 2, ...; every run ends with an end mark of its own, which is
smaller than all symbols, so no match crosses two runs and suffixes are compared up to the end of their run only.
"""

from __future__ import annotations

import numpy as np

#: Every so many-th position of a run, counted from its start, has its suffix position stored.
SAMPLE = 8


def suffix_order(ranks: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence by prefix doubling; equal prefixes end at unique end marks."""
    n, step = len(ranks), 1
    order = np.argsort(ranks, kind="stable")
    while True:
        ordered = ranks[order]
        new = np.r_[False, ordered[1:] != ordered[:-1]]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(new)
        if fresh[order[-1]] == n - 1:
            return order
        ahead = np.zeros(n, np.int64)
        ahead[:max(n - step, 0)] = fresh[step:]
        ranks = fresh * n + ahead
        order = np.argsort(ranks, kind="stable")
        step *= 2


class Wavelet:
    """Rank of any symbol before any position of a sequence, one bit of the symbol per level."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels = []
        for bit in range(int(largest).bit_length() - 1, -1, -1):
            high = (symbols >> bit) & 1 == 1
            zeros = np.r_[0, np.cumsum(~high)]
            self.levels.append((bit, zeros))
            symbols = np.concatenate([symbols[~high], symbols[high]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        first = np.zeros_like(at)
        for bit, zeros in self.levels:
            high = (symbol >> bit) & 1 == 1
            at = np.where(high, zeros[-1] + at - zeros[at], zeros[at])
            first = np.where(high, zeros[-1] + first - zeros[first], zeros[first])
        return at - first


class Index:
    """Index of a sequence of runs; ``symbols`` holds them one after the other, ``ends`` the end of each run."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, largest: int):
        runs, lengths = len(ends), np.diff(np.r_[0, ends])
        marks = ends + np.arange(runs)  # end marks stand after their runs
        n = len(symbols) + runs
        text = np.zeros(n, np.int64)
        is_mark = np.zeros(n, bool)
        is_mark[marks] = True
        text[~is_mark] = symbols
        self.source = np.cumsum(~is_mark) - 1  # position in ``symbols`` of a position in the text
        ranks = text + runs - 1
        ranks[marks] = np.arange(runs)
        order = suffix_order(ranks)
        self.bwt = text[order - 1]
        counts = np.bincount(symbols, minlength=largest + 2)
        self.before = runs + np.r_[0, np.cumsum(counts)]
        self.tree = Wavelet(self.bwt, largest)
        starts = np.repeat(np.r_[0, marks[:-1] + 1], lengths + 1)
        kept = (np.arange(n) - starts) % SAMPLE == 0
        self.sampled = np.where(kept[order], order, -1)

    def find(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of phrases, which stand at the right of the rows; returns phrase and row range of each match."""
        width = phrases.shape[1]
        live = np.arange(len(phrases))
        last = phrases[:, width - 1]
        low, high = self.before[last], self.before[last + 1]
        for j in range(1, width):
            on = low < high
            live, low, high = live[on], low[on], high[on]
            more = lengths[live] > j
            c = phrases[live[more], width - 1 - j]
            low[more] = self.before[c] + self.tree.rank(c, low[more])
            high[more] = self.before[c] + self.tree.rank(c, high[more])
        on = low < high
        live, low, high = live[on], low[on], high[on]
        size = high - low
        rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        return np.repeat(live, size), rows

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in ``symbols`` where the suffixes of the rows start: step back to a sampled one."""
        steps = np.zeros(len(rows), np.int64)
        rows = rows.copy()
        open_ = np.flatnonzero(self.sampled[rows] < 0)
        while len(open_):
            c = self.bwt[rows[open_]]
            rows[open_] = self.before[c] + self.tree.rank(c, rows[open_])
            steps[open_] += 1
            open_ = open_[self.sampled[rows[open_]] < 0]
        return self.source[self.sampled[rows] + steps]
