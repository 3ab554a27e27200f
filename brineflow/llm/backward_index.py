"""A compressed full-text index over sequences of symbols, searched backwards for many patterns at once.

The text is the given sequences, each ended by a symbol of its own. Kept are the runs of equal symbols of the
Burrows-Wheeler transform, sorted by symbol and place with the symbols before each, so that a rank is one binary search
over the runs, and the sequence each row belongs to. Similar sequences give long runs. All patterns advance by one
symbol at a time with array operations.
"""

from __future__ import annotations

import numpy as np


def _suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix order by doubling; ends differ, so it takes log2 of the longest sequence rounds."""
    n = len(text)
    rank = text.astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1
        order = np.argsort(rank * (int(rank.max()) + 2) + after, kind="stable")
        changed = np.zeros(n, dtype=np.int64)
        changed[1:] = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(changed)
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        step *= 2


class BackwardIndex:
    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        """`flat` holds symbols > 0 of all sequences one after another, `lengths` how many each has."""
        count = len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        n = int(lengths.sum()) + count
        text = np.empty(n, dtype=np.int64)
        is_end = np.zeros(n, dtype=bool)
        is_end[ends] = True
        text[is_end] = np.arange(count)
        text[~is_end] = flat + count
        order = _suffix_order(text)
        self.n, self.first = n, count
        self.bwt = text[order - 1]  # row 0's predecessor wraps around
        self.owner = np.repeat(np.arange(count), lengths + 1)[order]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text))])  # rows that start with a smaller symbol
        starts = np.flatnonzero(np.diff(self.bwt, prepend=-1))
        sizes = np.diff(starts, append=n)
        by_symbol = np.lexsort((starts, self.bwt[starts]))
        self.starts, self.sizes, self.symbols = starts[by_symbol], sizes[by_symbol], self.bwt[starts][by_symbol]
        self.before = np.cumsum(self.sizes) - self.sizes
        self.keys = self.symbols * n + self.starts

    def _rows(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Where the suffixes that start with `symbol` and go on with one of the rows before `row` end."""
        symbol = symbol + self.first
        at = np.searchsorted(self.keys, symbol * self.n + row) - 1
        run = np.maximum(at, 0)
        taken = np.where(self.symbols[run] == symbol, np.minimum(row - self.starts[run], self.sizes[run]), self.sizes[run])
        return np.where(at < 0, 0, self.before[run] + taken)

    def single(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose suffixes start with `symbol`."""
        return self.below[symbol + self.first], self.below[symbol + self.first + 1]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose suffixes start with `symbol` followed by what rows low..high start with."""
        return self._rows(symbol, low), self._rows(symbol, high)

    def maximal_matches(self, patterns: np.ndarray, lengths: np.ndarray, anywhere: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, sequence, span): for every occurrence of a pattern's last symbol, how far the pattern matches to its left.

        `patterns` is a matrix, one row per pattern with its last symbol first and anything behind its end; a symbol
        the text doesn't have is -1. With `anywhere`, matches that end at any symbol of the pattern count, each of them
        once, with its whole span: those that the symbol to the right would lengthen are left out.
        """
        matrix = np.asarray(patterns)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if not anywhere:
            which, place = np.arange(len(matrix)), np.zeros(len(matrix), dtype=np.int64)
        else:
            which, place = np.nonzero(np.arange(matrix.shape[1]) < lengths[:, None])
        symbol = matrix[which, place]
        which, place, symbol = which[symbol > 0], place[symbol > 0], symbol[symbol > 0]
        low, high = self.single(symbol)
        # rows that the symbol to the right would lengthen, always among the others
        right = np.where(place > 0, matrix[which, np.maximum(place - 1, 0)], -1)
        longer = np.flatnonzero(right > 0)
        out_low, out_high = low.copy(), low.copy()
        out_low[longer], out_high[longer] = self.step(symbol[longer], *self.single(right[longer]))
        span = 1
        while True:
            alive = high - low > out_high - out_low
            which, place, low, high, out_low, out_high = (x[alive] for x in (which, place, low, high, out_low, out_high))
            if not len(which):
                break
            ahead = place + span
            symbol = np.where(ahead < lengths[which], matrix[which, np.minimum(ahead, matrix.shape[1] - 1)], -1)
            kept = (out_low - low) + (high - out_high)
            index = np.repeat(np.arange(len(which)), kept)
            rows = np.arange(len(index)) - np.repeat(np.cumsum(kept) - kept, kept) + low[index]
            rows += np.where(rows >= out_low[index], (out_high - out_low)[index], 0)
            stops = (symbol[index] < 0) | (self.bwt[rows] != symbol[index] + self.first)
            found.append((which[index[stops]], self.owner[rows[stops]], np.full(int(stops.sum()), span)))
            go = symbol > 0
            which, place, symbol, low, high, out_low, out_high = (x[go] for x in (which, place, symbol, low, high, out_low, out_high))
            low, high = self.step(symbol, low, high)
            longer = np.flatnonzero(out_high > out_low)
            ahead_low, ahead_high = self.step(symbol[longer], out_low[longer], out_high[longer])
            out_low, out_high = low.copy(), low.copy()
            out_low[longer], out_high[longer] = ahead_low, ahead_high
            span += 1
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found))
