"""A compressed FM-index over sequences of symbols: a wavelet matrix of the Burrows-Wheeler transform.

The index answers, for many query sequences at once, how long a match starts at each place (matching
statistics), up to a depth that is given when it is built. Suffixes are sorted by more symbols than that.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)[:-1]]).astype(np.int32)
        self.zeros = len(bits) - int(counts.sum())

    def ones_before(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Rank of any symbol at any place, one bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.levels: list[BitVector] = []
        rest = symbols
        for level in range(self.depth - 1, -1, -1):
            bits = (rest >> level) & 1
            self.levels.append(BitVector(bits))
            rest = np.concatenate([rest[bits == 0], rest[bits == 1]])
        every = np.arange(n_symbols)
        self.begin = self._follow(every, np.zeros(n_symbols, np.int64))

    def _follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.depth - 1, -1, -1), self.levels):
            ones = bits.ones_before(at)
            at = np.where((symbol >> level) & 1, bits.zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``at``."""
        return self._follow(symbol, at) - self.begin[symbol]


class FMIndex:
    """``symbols`` are numbers from 1; 0 separates the sequences and never matches.

    Matches are told up to ``depth`` symbols.
    """

    def __init__(self, symbols: np.ndarray, depth: int = 15):
        n = len(symbols)
        self.n_symbols = int(symbols.max(initial=0)) + 1
        ranks = {1: symbols.astype(np.int64)}
        length = 1
        # What suffixes share is known up to one symbol less than they are sorted by.
        while length <= depth:
            last = ranks[length]
            following = np.zeros(n, np.int64)
            following[: max(n - length, 0)] = last[length:]
            both = last * (int(following.max(initial=0)) + 1) + following
            _, ranks[2 * length] = np.unique(both, return_inverse=True)
            length *= 2
        self.order = np.argsort(ranks[length], kind="stable")
        self.bwt = WaveletMatrix(symbols[self.order - 1], self.n_symbols)
        counts = np.bincount(symbols, minlength=self.n_symbols)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        self._common(ranks, n)
        self._starts: dict[int, np.ndarray] = {}
        self.size = n

    def _common(self, ranks: dict[int, np.ndarray], n: int) -> None:
        """How many symbols each suffix shares with the one before it, up to one less than the sorted depth."""
        shared = np.zeros(n, np.int64)
        for length in sorted(ranks, reverse=True)[1:]:
            padded = np.append(ranks[length], np.full(max(ranks), -1))
            here, before = self.order + shared, np.roll(self.order, 1) + shared
            shared += np.where((padded[here] == padded[before]) & (here + length <= n), length, 0)
        if n:
            shared[0] = -1
        self.shared = shared.astype(np.int32)

    def blocks(self, depth: int) -> np.ndarray:
        """First rows of the blocks of suffixes that agree in ``depth`` symbols, and the end."""
        if depth not in self._starts:
            self._starts[depth] = np.append(np.flatnonzero(self.shared < depth), self.size)
        return self._starts[depth]

    def block_of(self, depth: int, row: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.blocks(depth), row, "right") - 1

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the rows of ``symbol`` followed by what ``low``-``high`` match."""
        known = (symbol > 0) & (symbol < self.n_symbols)
        symbol = np.where(known, symbol, 0)
        found = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        low, high = np.split(found, 2)
        base = self.smaller[symbol]
        return base + low, np.where(known, base + high, base + low)

    def matching_statistics(
        self, queries: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the queries the length of the longest match from there, up to ``depth``,
        and the first row of the suffixes that match.

        All queries are read from their ends at once. Where a match cannot grow to the left, or has
        the full depth, it is shortened from the right: its rows widen to those sharing one symbol less.
        """
        lengths = np.zeros(len(queries), np.int64)
        rows = np.zeros(len(queries), np.int64)
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.size)
        matched = np.zeros(len(starts), np.int64)
        active = np.flatnonzero(ends > starts)
        step = 1
        while len(active):
            at = ends[active] - step
            todo = active
            full = todo[matched[todo] == depth]
            self._shorten(full, low, high, matched)
            place = at
            while len(todo):
                new_low, new_high = self.extend(queries[place], low[todo], high[todo])
                grown = new_high > new_low
                done = todo[grown]
                low[done], high[done] = new_low[grown], new_high[grown]
                matched[done] += 1
                retry = ~grown & (matched[todo] > 0)
                lost = todo[~grown & ~retry]
                low[lost], high[lost] = 0, self.size
                todo, place = todo[retry], place[retry]
                self._shorten(todo, low, high, matched)
            lengths[at], rows[at] = matched[active], low[active]
            step += 1
            active = active[ends[active] - step >= starts[active]]
        return lengths, rows

    def _shorten(self, which: np.ndarray, low: np.ndarray, high: np.ndarray, matched: np.ndarray) -> None:
        for length in np.unique(matched[which]):
            some = which[matched[which] == length]
            starts, block = self.blocks(int(length) - 1), self.block_of(int(length) - 1, low[some])
            low[some], high[some] = starts[block], starts[block + 1]
            matched[some] = length - 1
