"""A compressed full-text index of word sequences: BWT in a wavelet matrix, backward search, matching statistics."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with a directory: rank in constant time, 1.5 bits a bit."""

    def __init__(self, bit: np.ndarray):
        self.words = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        at = place >> 6
        inside = self.words[at] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[at] + np.bitwise_count(inside)


class WaveletMatrix:
    """Rank over a sequence of numbers, a bit vector for each of their bits; n * log2(largest) bits and directories."""

    def __init__(self, sequence: np.ndarray):
        self.n = len(sequence)
        self.depth = max(1, int(sequence.max(initial=0)).bit_length())
        self.bits, self.zeros = [], []
        for level in range(self.depth - 1, -1, -1):
            bit = (sequence >> level & 1).astype(bool)
            self.bits.append(Bits(bit))
            self.zeros.append(int(self.n - bit.sum()))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place, counted from the start of the symbol's run (see ``first``)."""
        for k in range(self.depth):
            ones = self.bits[k].rank(place)
            place = np.where(symbol >> (self.depth - 1 - k) & 1, self.zeros[k] + ones, place - ones)
        return place

    def first(self, sigma: int) -> np.ndarray:
        """Where the run of each symbol starts in the last level: what ``rank`` counts from."""
        return self.rank(np.arange(sigma), np.zeros(sigma, np.int64))


class Edges:
    """Where neighbouring suffixes differ: their common prefixes' lengths, a byte each, and minima of 64 and of 64 of those."""

    def __init__(self, common: np.ndarray):
        self.levels = []
        while True:
            rows = np.concatenate([common, np.zeros(-len(common) % 64, np.uint8)]).reshape(-1, 64)
            self.levels.append(rows)
            if len(rows) == 1:
                break
            common = rows.min(axis=1)

    def find(self, place: np.ndarray, length: np.ndarray, step: int, level: int = 0) -> np.ndarray:
        """The nearest place at or before (``step`` -1) or at or after (1) each where less than ``length`` is common."""
        rows, inside = place >> 6, place & 63
        column = np.arange(64)
        fit = (self.levels[level][rows] < length[:, None]) & (column <= inside[:, None] if step < 0 else column >= inside[:, None])
        if step < 0:
            fit = fit[:, ::-1]
        found = fit.argmax(axis=1)
        none = np.flatnonzero(~fit[np.arange(len(place)), found])
        out = rows * 64 + (63 - found if step < 0 else found)
        if len(none):
            row = self.find(rows[none] + step, length[none], step, level + 1)
            out[none] = self.find(row * 64 + (63 if step < 0 else 0), length[none], step, level)
        return out


class FMIndex:
    """Index of sequences of symbols from 1, each ended by 0, with a key for each sequence.

    Kept are the Burrows-Wheeler transform in a wavelet matrix, the lengths of neighbours' common prefixes, a byte each, a
    bit vector that marks where the suffixes' first ``width`` symbols change, and for each block of equal ones the
    smallest key (``least``). The suffix order itself is dropped: it is sorted by as many symbols as a power of two above
    ``width``, as many as backward search ever matches here.
    """

    def __init__(self, symbols: np.ndarray, keys: np.ndarray, width: int):
        n, span = len(symbols), 1
        self.n, self.width, rank, ranks = n, width, symbols.astype(np.int64), []
        while span <= width:
            ranks.append((span, rank.astype(np.int32)))
            after = np.zeros(n, np.int64)
            after[: n - span] = rank[span:] + 1
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key)
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
            rank, span = new, 2 * span
        one, two = order[:-1], order[1:]
        common = np.where(rank[one] == rank[two], span, 0)
        for span, rank in reversed(ranks):
            open_ = np.flatnonzero((common < 2 * ranks[-1][0]) & (np.maximum(one, two) + common < n))
            same = open_[rank[one[open_] + common[open_]] == rank[two[open_] + common[open_]]]
            common[same] += span
        common = np.concatenate([[0], np.minimum(common, 255), [0]]).astype(np.uint8)
        self.edges = Edges(common)
        new = common[:-1] < width
        self.marks = Bits(new)
        owner = np.cumsum(symbols == 0) - (symbols == 0)
        self.least = np.minimum.reduceat(keys[owner[order]], np.flatnonzero(new))
        self.sigma = int(symbols.max(initial=0)) + 1
        self.tree = WaveletMatrix(symbols[order - 1])
        counts = np.bincount(symbols, minlength=self.sigma)
        self.base = np.cumsum(counts) - counts - self.tree.first(self.sigma)

    def left(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches after one more symbol on the left; empty for symbols that the index lacks."""
        known = (symbol > 0) & (symbol < self.sigma)
        c = np.where(known, symbol, 0)
        both = self.base[np.concatenate([c, c])] + self.tree.rank(np.concatenate([c, c]), np.concatenate([low, high]))
        return np.where(known, both[: len(c)], 0), np.where(known, both[len(c) :], 0)

    def shorten(self, low: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first ``length`` symbols of the matches at ``low``."""
        down, up = np.zeros(len(low), np.int64), np.full(len(low), self.n)
        on = np.flatnonzero(length > 0)
        down[on], up[on] = self.edges.find(low[on], length[on], -1), self.edges.find(low[on] + 1, length[on], 1)
        return down, up

    def _longest(self, symbol: np.ndarray, low: np.ndarray, least: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many symbols of the matches at ``low``, from ``least`` to less than ``below``, may follow ``symbol``, and the
        intervals with it: by doubling, then bisection. -1 where not even ``least`` fit."""
        best, down, up = np.full(len(low), -1), np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
        probe, step, most = least.copy(), np.ones(len(low), np.int64), below - 1
        while len(on := np.flatnonzero(probe <= most)):
            a, b = self.left(symbol[on], *self.shorten(low[on], probe[on]))
            fits = a < b
            yes, no = on[fits], on[~fits]
            best[yes], down[yes], up[yes] = probe[yes], a[fits], b[fits]
            most[no], step[no] = np.where(best[no] < 0, -2, probe[no] - 1), 0
            step[yes] *= 2
            probe[on] = np.where(step[on] > 0, np.minimum(best[on] + step[on], np.maximum(most[on], best[on] + 1)), (best[on] + most[on] + 2) // 2)
        return best, down, up

    def matches(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each place of ``text`` the block of the ``width`` symbols that start there, if they lie in one of the spans
        text[start:end] and the index holds them; else -1. Spans are shorter than 2 * width.

        These are the matching statistics that reach ``width``. All spans are read from right to left at once, by backward
        search. A match of full width drops its last symbols. Where a symbol doesn't fit, the match is shortened on the
        right to the most that may follow it. All windows of a span hold the symbols that its first and its last window
        share, so a span is done once its match can't reach their end.
        """
        block = np.full(len(text), -1, np.int64)
        bound = start + self.width
        place, stop = end.copy(), end.copy()  # text[place:stop] matches
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.n)
        on = np.flatnonzero(start < place)
        while len(on):
            at = place[on] - 1
            down, up = self.left(text[at], low[on], high[on])
            reach = stop[on]
            lost = np.flatnonzero(down >= up)
            if len(lost):
                here = at[lost]
                need = np.maximum(bound[on[lost]] - here - 1, 0)
                best, down[lost], up[lost] = self._longest(text[here], low[on[lost]], need, reach[lost] - here - 1)
                none = (best < 0) & (here >= bound[on[lost]])  # nothing follows, but nothing has to
                up[lost[none]] = self.n
                reach[lost] = np.where(best < 0, here, here + 1 + best)
                alive = np.ones(len(on), bool)
                alive[lost[(best < 0) & ~none]] = False
                on, at, down, up, reach = on[alive], at[alive], down[alive], up[alive], reach[alive]
            place[on], low[on], high[on], stop[on] = at, down, up, reach
            full = on[reach - at >= self.width]
            if len(full):
                block[place[full]] = self.marks.rank(low[full] + 1) - 1
                stop[full] = place[full] + self.width
                low[full], high[full] = self.shorten(low[full], np.full(len(full), self.width))
            on = on[start[on] < place[on]]
        return block
