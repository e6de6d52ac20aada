"""Words, n-grams and their hashes, computed for a whole Arrow batch of texts at once."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa

SLICE_BYTES, SLICE_DOCUMENTS = 2 << 20, (1 << 16) - 1

_POLY = np.uint64(0x9E3779B97F4A7C15)


def cached(key: str, make: Callable):
    """A value that a Python worker keeps from task to task."""
    held = sys.modules.setdefault("_podlens_llm_held", ModuleType("_podlens_llm_held"))
    if not hasattr(held, key):
        setattr(held, key, make())
    return getattr(held, key)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of splitmix)."""
    x = np.asarray(x).astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_table() -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64), 7)


def _powers(n: int) -> np.ndarray:
    held = cached("powers", lambda: np.cumprod(np.full(1 << 12, _POLY, np.uint64)))
    return held[:n] if n <= len(held) else np.cumprod(np.full(n, _POLY, np.uint64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and where each begins (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of up to 65,535 documents and about ``limit`` bytes; a longer document has a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n, first + SLICE_DOCUMENTS)
        yield first, last
        first = last


def runs(counts: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... in each run of the given lengths."""
    counts = np.asarray(counts, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def run_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each (non-empty) run of bytes; runs lie in order and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = runs(lengths)
    values = _byte_table()[data[np.repeat(starts, lengths) + place]]
    values *= _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, np.cumsum(lengths) - lengths))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts: places in the bytes, and counts per document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = (data != 32) & ((data < 9) | (data > 13))
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(data)]
        begins[cuts] = inside[cuts]
        self.starts = np.flatnonzero(begins)
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        cuts = offsets[1:][offsets[1:] > 0] - 1
        ends[cuts] = inside[cuts]
        self.ends = np.flatnonzero(ends) + 1
        self.inside = inside
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return run_hashes(self.data, self.starts, self.ends - self.starts)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers where a window of ``n`` words of one document starts, and the window's hash."""
        return windows(self.hashes(), self.first, n)


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    total = len(hashes)
    if total < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.zeros(total - n + 1, np.uint64)
    factor = np.uint64(1)
    for k in range(n):
        sums += hashes[k : total - n + 1 + k] * factor
        factor = np.uint64(int(factor) * int(_POLY) & (2**64 - 1))
    end = np.repeat(first[1:], np.diff(first))[: total - n + 1]
    at = np.flatnonzero(np.arange(total - n + 1) + n <= end)
    return at, mix(sums[at])


def covered(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a window of ``n`` words that starts at one of ``at``."""
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, np.minimum(at + n, total), -1)
    return np.cumsum(steps[:-1]) > 0


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of the values of each run that begins at ``first[i]`` and ends before ``first[i + 1]``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
