"""Op 2: winnowing fingerprints.

Hashes of all k-grams of code points; of every window of consecutive hashes the smallest is kept, of
equal ones the rightmost. Any stretch of ``gram + window - 1`` code points that two texts share gives
both at least one common hash, and its position is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podlens.llm.arrow_text import mix, text_buffers
from podlens.llm.tables import pieces, prepare, text_bytes

GRAM, WINDOW = 8, 16
RANGE_BYTES = 16 << 20
NO_ID = -(2**63)

_GRAM_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def code_points(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")


def gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """The rolling hash of each k-gram; a text shorter than that is one gram."""
    n = max(len(points) - gram + 1, 1)
    total = np.zeros(n, np.uint64)
    factor = np.uint64(1)
    for k in range(min(gram, len(points))):
        total += (points[k : k + n].astype(np.uint64) + np.uint64(1)) * factor
        factor = np.uint64(int(factor) * int(_GRAM_FACTOR) & (2**64 - 1))
    return (mix(total) >> np.uint64(32)).astype(np.int64)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the selected hashes; with fewer hashes than a window, that of the smallest."""
    n = len(hashes)
    width = min(window, n)
    # The place in the low bits makes the rightmost of equal hashes the smallest.
    keys = (hashes << 31) | (n - 1 - np.arange(n))
    span = 1
    smallest = keys
    while span * 2 <= width:
        smallest = np.minimum(smallest[:-span], smallest[span:])
        span *= 2
    rest = width - span
    if rest:
        smallest = np.minimum(smallest[: len(smallest) - rest], smallest[rest:])
    places = n - 1 - (smallest & ((1 << 31) - 1))
    return places[np.flatnonzero(np.diff(places, prepend=-1))]


def selected(points: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The selected hashes of a text and their positions in it, in order of position."""
    hashes = gram_hashes(points, gram)
    places = winnow(hashes, window)
    return hashes[places], places


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sets of distinct sorted hashes (Jaccard)."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def as_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``doc_id``, the selected ``hashes`` in order of position, and their ``positions`` (code points).

    A null text counts as empty; an empty or short text has one hash. Rows that repeat give equal
    rows; an empty table gives none. Columns other than ``doc_id`` and ``text`` are not read.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch["text"])
            raw = data.tobytes()
            found = [selected(code_points(raw[a:b]), gram, window) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array([hashes for hashes, _ in found], pa.list_(pa.int64())),
                    pa.array([places for _, places in found], pa.list_(pa.int64())),
                ],
                names=["doc_id", "hashes", "positions"],
            )

    schema = f"doc_id {kind}, hashes array<long>, positions array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def with_successors(docs: DataFrame) -> DataFrame:
    """The documents dealt into ranges of ``doc_id``, each range followed by the first of the next.

    Columns: ``part``, ``guest`` (true for the first document of the next range), ``doc_id``, ``text``.
    After the last range comes the first document of all. All tasks know the smallest id of each
    range, one number for each 16 MB of text.
    """
    n = pieces(text_bytes(docs), RANGE_BYTES, 16)
    # Ids are ordered as numbers or else as texts, with null before all of them.
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    else:
        key = F.coalesce(F.concat(F.lit("+"), F.col("doc_id").cast("string")), F.lit(""))
    rows = docs.select("doc_id", key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = rows.select("key").repartitionByRange(n, "key").groupBy(F.spark_partition_id())
    lows = sorted(row[1] for row in ranged.agg(F.min("key")).collect())
    lows = np.array(lows, np.int64 if not lows or isinstance(lows[0], int) else object)

    @F.pandas_udf("array<int>")
    def parts(keys: pd.Series) -> pd.Series:
        part = np.searchsorted(lows, keys.to_numpy(), "right") - 1
        guest = lows[part] == keys.to_numpy()
        before = (part - 1) % len(lows)
        return pd.Series([[p, ~b] if g else [p] for p, b, g in zip(part, before, guest)])

    dealt = rows.select("doc_id", "key", "text", F.explode(parts("key")).alias("to"))
    guest = F.col("to") < 0
    part = F.when(guest, F.bitwise_not("to")).otherwise(F.col("to"))
    dealt = dealt.select(part.alias("part"), guest.alias("guest"), "doc_id", "key", "text")
    order = ["part", "guest", "key", F.xxhash64("text")]
    return dealt.repartition(n, "part").sortWithinPartitions(*order).drop("key")


def edited_fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of the text with its last quarter replaced, and their likeness.

    The last ``floor(n / 4)`` code points give way to the first as many of the document with the next
    larger id (or to all of it); the largest id is followed by the smallest. Ids that are no integers are
    ordered as texts. A null text counts as empty. A null id comes before all others. Rows that repeat an id follow one another, ordered by a
    hash of the text. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = with_successors(docs)

    def compare(item: tuple, following: tuple) -> tuple:
        doc_id, points, hashes = item
        _, next_points, next_hashes = following
        cut = len(points) // 4
        edited = np.concatenate([points[: len(points) - cut], next_points[:cut]])
        edited_hashes = np.unique(selected(edited, gram, window)[0])
        text = edited.tobytes().decode("utf-32-le", "replace")
        return (
            doc_id,
            len(points),
            hashlib.sha256(text.encode()).hexdigest(),
            as_text(hashes),
            as_text(edited_hashes),
            likeness(hashes, edited_hashes),
            likeness(hashes, next_hashes),
        )

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = (
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_part, held_guest = None, None, False
        for batch in batches:
            data, offsets = text_buffers(batch["text"])
            raw = data.tobytes()
            parts, guests, ids = (batch[name].to_pylist() for name in ("part", "guest", "doc_id"))
            out = []
            for k, (a, b) in enumerate(zip(offsets, offsets[1:])):
                points = code_points(raw[a:b])
                item = ids[k], points, np.unique(selected(points, gram, window)[0])
                if held is not None and held_part == parts[k] and not held_guest:
                    out.append(compare(held, item))
                held, held_part, held_guest = item, parts[k], guests[k]
            if out:
                types = [batch["doc_id"].type, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return rows.mapInArrow(run, schema)
