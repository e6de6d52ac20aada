"""Compact exchange of hashes between blocks of documents and buckets of hashes.

A block of documents asks about its distinct hashes. The hashes are dealt into buckets by value; a
block sends each bucket one compressed row and later gets one back, in the same order. So a hash that
occurs in every document is still sent only once by each block, and no bucket sees single occurrences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray) -> bytes:
    """Sorted (or any) 64-bit numbers as differences, byte plane by byte plane, compressed."""
    values = np.asarray(values).astype(np.uint64)
    steps = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(raw, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_plain(values: np.ndarray) -> bytes:
    """Unordered numbers, without differences."""
    size = values.dtype.itemsize
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, size).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_plain(raw: bytes, n: int, dtype) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype)
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(raw, size * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).ravel()


def deal(values: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Where each of ``n`` buckets begins in sorted values of ``bits`` bits: equal spans of values."""
    bounds = [(k << bits) // n for k in range(n)]
    return np.append(np.searchsorted(values, np.array(bounds, np.uint64)), len(values))


def binaries(column: pa.ChunkedArray) -> list[bytes]:
    return column.to_pylist()
