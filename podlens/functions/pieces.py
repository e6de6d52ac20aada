"""Hashed pieces of texts, and a table of bits that tells which of them may be looked for.

A text has about as many pieces of a length as characters, of which few are looked for. They are hashed and
sifted by whole batches; only those that pass become rows. Pieces are pieces of the UTF-8 bytes. Two pieces may
get one key, so what is found by a key is compared after that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GRAM = 3
# The lengths of pieces in bytes, each twice the next.
SIZES = (24, 12, 6, GRAM)
# About so many bytes of texts are hashed at once; every byte takes some numbers of eight.
SLICE = 1 << 17

_BASE = 0x9E3779B97F4A7C15
# Where the bits of a key lie in its word of the table.
_SHIFTS = (0, 6, 12, 18)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _mixed(numbers: np.ndarray) -> np.ndarray:
    numbers = (numbers ^ (numbers >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    numbers = (numbers ^ (numbers >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return numbers ^ (numbers >> np.uint64(31))


_SIGNS = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _rolled(signs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For every length of :data:`SIZES` the hash of the piece that begins at each place."""
    hashes = signs[:-2] * _power(2) + signs[1:-1] * _power(1) + signs[2:]
    for n in reversed(SIZES):
        yield n, hashes
        hashes = hashes[:-n] * _power(n) + hashes[n:]


def piece_keys(
    texts: pa.Array, lists: np.ndarray, sizes: set[int], own: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the texts with the keys of their pieces of these lengths, some rows at a time.

    A key holds the number of the row in ``lists``. Length 0 is the empty piece, which every text has once. With
    ``own``, a row has pieces of the one length that stands there.
    """
    if not len(texts):
        return
    binary = texts.cast(pa.large_binary())
    _, where, data = binary.buffers()
    offsets = np.frombuffer(where, np.int64)[binary.offset : binary.offset + len(binary) + 1]
    signs = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    salts = lists.view(np.uint64)
    first = 0
    while first < len(binary):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        row = np.repeat(np.arange(first, last), np.diff(offsets[first : last + 1]))
        pieces = [(0, np.arange(first, last), np.zeros(last - first, np.uint64))] if 0 in sizes else []
        for n, hashes in _rolled(_SIGNS[signs[offsets[first] : offsets[last]]]):
            if n in sizes:
                within = row[: len(hashes)] == row[n - 1 :]
                pieces.append((n, row[: len(hashes)][within], hashes[within]))
        for n, rows, hashes in pieces:
            if own is not None:
                wanted = own[rows] == n
                rows, hashes = rows[wanted], hashes[wanted]
            yield rows, _mixed(hashes ^ _mixed(salts[rows] + np.uint64(n)))
        first = last


def _places(keys: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word of each key in a table, and the bits that it has there."""
    index = keys >> np.uint64(65 - len(words).bit_length())
    bits = np.zeros(len(keys), np.uint64)
    for shift in _SHIFTS:
        bits |= np.uint64(1) << ((keys >> np.uint64(shift)) & np.uint64(63))
    return index.astype(np.int64), bits


def sieve(keys: np.ndarray) -> np.ndarray:
    """A table of 16 to 32 bits for each key, in words of 64."""
    words = np.zeros(1 << max(1, (len(keys) // 4).bit_length()), np.uint64)
    index, bits = _places(keys, words)
    np.bitwise_or.at(words, index, bits)
    return words


def passed(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which keys may be among those of a table: all that are, and about one in 200 of the others."""
    index, bits = _places(keys, words)
    return (words[index] & bits) == bits
