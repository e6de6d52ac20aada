"""Op 1: token sequences of fixed length, filled along a space-filling curve through the documents.

Every document becomes a hashed token vector, three fixed projections of it become a place on a
Hilbert curve, and documents that lie next to each other on the curve are packed next to each other.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podlens.llm.arrow_text import cached, mix, text_buffers
from podlens.llm.tables import pieces, prepare, store

END_ID = 1
FEATURES, DIMENSIONS, BITS = 512, 3, 16
# Ties on the curve are spread by a hash of the document, so that a range never holds one key alone.
TIE_BITS = 63 - DIMENSIONS * BITS
# Not the apostrophe, which may begin a token together with letters.
STOPS = b".,;:!?#$%&*|+=<>()/-\"_~"
# Letters below this sign are in normal form C, and lower case maps each of them alone.
PLAIN_END = "\u0250"
HELD_WORDS = 500_000
ENCODE_WORDS = 512
RANGE_TOKENS = 8_000_000
DOCUMENTS_AT_ONCE = 64

_ROW = "row long, doc_id {id}, place long, n_tokens long, ids binary"
_PLACED = "row long, part int, before long, n_tokens long"
_PIECE = "doc_id {id}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _ends_with_letter(word: bytes) -> bool:
    if word[-1:].isalpha():
        return True
    last = word.decode("utf-8", "replace")[-1:]
    # Some letters get a mark in lower case, which would join the punctuation.
    return last.isalpha() and last.lower().isalpha()


class WordEncoder:
    """Token ids of texts, as bytes of 16-bit numbers, with the words seen lately kept by content.

    The vocabulary splits at white space before anything else, so a text's ids are those of its words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same merges for words of plain small letters, which need no other step before them.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), to_bytes])
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("the vocabulary has ids beyond 16 bits")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.held: dict[bytes, bytes] = {}

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u2").tobytes()

    def _learn(self, words: set[bytes]) -> None:
        """Letters-only words are encoded many at a time: each gives one run up to a word end."""
        plain, letters = [], []
        for word in words:
            text = word.decode("utf-8", "replace")
            small = text.lower()
            if not small.isalpha() or not text.isalpha():
                self.held[word] = self._whole(text)
            elif small.isascii() or max(small) < PLAIN_END:
                plain.append((word, small))
            else:
                letters.append((word, text))
        self._learn_runs(plain, self.plain)
        self._learn_runs(letters, self.tokenizer)

    def _learn_runs(self, words: list[tuple[bytes, str]], tokenizer) -> None:
        groups = [words[i : i + ENCODE_WORDS] for i in range(0, len(words), ENCODE_WORDS)]
        joined = [" ".join(text for _, text in group) for group in groups]
        for group, found in zip(groups, tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(found.ids, "<u2")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group):
                self.held.update((word, self._whole(text)) for word, text in group)
                continue
            raw, cuts = ids.tobytes(), [0, *(2 * cuts).tolist()]
            self.held.update((word, raw[a:b]) for (word, _), a, b in zip(group, cuts, cuts[1:]))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        # Special tokens are only those in small letters, so a text that may hold one keeps its case.
        split = [(text if b"<|" in text else text.lower()).split() for text in texts]
        if len(self.held) > HELD_WORDS:
            self.held.clear()
        missing = set().union(*split).difference(self.held)
        # Punctuation behind a letter is split off before the merges, as one run.
        parts = {}
        for word in missing:
            stem = word.rstrip(STOPS)
            if len(stem) < len(word) and _ends_with_letter(stem) and b"<|" not in word:
                parts[word] = stem, word[len(stem) :]
        new = missing.difference(parts).union(*parts.values()).difference(self.held)
        if new:
            self._learn(new)
        for word, (stem, stops) in parts.items():
            self.held[word] = self.held[stem] + self.held[stops]
        get = self.held.__getitem__
        return [b"".join(map(get, words)) for words in split]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates of ``bits`` bits, one row each."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(flip, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> bit) & 1)
    return place


def _projection() -> np.ndarray:
    """A fixed matrix of plus and minus one."""
    signs = (mix(np.arange(FEATURES * DIMENSIONS), 11) >> np.uint64(63)).astype(np.float64)
    return signs.reshape(FEATURES, DIMENSIONS) * 2 - 1


def curve_places(found: list[bytes]) -> np.ndarray:
    """Coordinates of documents: hashed token counts, damped, scaled to length 1, projected."""
    slot = cached("slots", lambda: (mix(np.arange(1 << 16), 5) % np.uint64(FEATURES)).astype(np.int64))
    matrix = cached("projection", _projection)
    owner = np.repeat(np.arange(len(found)) * FEATURES, [len(ids) // 2 for ids in found])
    slots = owner + slot[np.frombuffer(b"".join(found), "<u2")]
    vectors = np.sqrt(np.bincount(slots, minlength=len(found) * FEATURES)).reshape(-1, FEATURES)
    lengths = np.sqrt((vectors**2).sum(1, keepdims=True))
    at = (vectors @ matrix) / np.where(lengths > 0, lengths, 1)
    # Projections of unit vectors lie within a few units of 0.
    return np.clip((at + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """A row per document: its number ``row``, its ids (16-bit, with the end id) and its place on the curve."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = cached(f"encoder {tokenizer}", lambda: WordEncoder(tokenizer))
        end = np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, DOCUMENTS_AT_ONCE):
                part = batch.slice(first, DOCUMENTS_AT_ONCE)
                data, offsets = text_buffers(part["text"])
                raw = data.tobytes()
                found = encoder.encode([raw[a:b] for a, b in zip(offsets, offsets[1:])])
                points = curve_places(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        part["row"],
                        part["doc_id"],
                        pa.array(hilbert(points, BITS)),
                        pa.array([len(ids) // 2 + 1 for ids in found], pa.int64()),
                        pa.array([ids + end for ids in found], pa.binary()),
                    ],
                    names=["row", "doc_id", "place", "n_tokens", "ids"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInArrow(encode, _ROW.format(id=kind))


def curve_starts(rows: DataFrame) -> DataFrame:
    """For each ``row`` the number of tokens before it on the curve, by range sort and two sums."""
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    n = pieces(total, RANGE_TOKENS, 16)
    tie = F.pmod(F.xxhash64("doc_id", "row"), F.lit(1 << TIE_BITS))
    order = F.shiftleft("place", TIE_BITS).bitwiseOR(tie)
    small = rows.select("row", "doc_id", "n_tokens", order.alias("at"))
    ranged = small.repartitionByRange(n, "at", "doc_id", "row").sortWithinPartitions("at", "doc_id", "row")
    ranged = ranged.select("row", "n_tokens", F.spark_partition_id().alias("part"))

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            n_tokens = batch["n_tokens"].to_numpy()
            sums = before + np.cumsum(n_tokens)
            before = int(sums[-1]) if len(sums) else before
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["part"], pa.array(sums - n_tokens), batch["n_tokens"]],
                names=["row", "part", "before", "n_tokens"],
            )

    placed = store(ranged.mapInArrow(running, _PLACED), "curve")
    # One row for each range: as many rows as partitions.
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(ahead), F.lit(0)).alias("base"))
    found = placed.join(F.broadcast(parts), "part")
    return found.select("row", (F.col("base") + F.col("before")).alias("at"))


def pack(docs: DataFrame, tokenizer: str, length: int = 2048) -> DataFrame:
    """Pieces of documents with their place in sequences of ``length`` ids.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read. A null or empty text is its end
    id alone. Documents are cut where a sequence is full, so only the last sequence is not. Rows that
    repeat (also with one id) are packed once each; rows without an id are kept, with a null id. An
    empty table gives no pieces. ``ids`` holds the piece's ids as little-endian 32-bit numbers.
    """
    prepare(docs.sparkSession)
    rows = store(tokenised(docs, tokenizer), "tokens", "zstd")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, DOCUMENTS_AT_ONCE):
                part = batch.slice(first, DOCUMENTS_AT_ONCE)
                at, n = part["at"].to_numpy(), part["n_tokens"].to_numpy()
                counts = (at + n - 1) // length - at // length + 1
                doc = np.repeat(np.arange(len(n)), counts)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
                sequence = at[doc] // length + number
                start = np.maximum(sequence * length - at[doc], 0)
                size = np.minimum((sequence + 1) * length - at[doc], n[doc]) - start
                wide = [np.frombuffer(ids.as_buffer(), "<u2").astype("<u4") for ids in part["ids"]]
                cuts = [wide[d][a : a + s].tobytes() for d, a, s in zip(doc, start, size)]
                columns = [start, size, n[doc], sequence, at[doc] + start - sequence * length]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].take(pa.array(doc)), *map(pa.array, columns), pa.array(cuts, pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
                )

    placed = rows.select("row", "doc_id", "n_tokens", "ids").join(curve_starts(rows), "row")
    return placed.select("doc_id", "n_tokens", "ids", "at").mapInArrow(cut, _PIECE.format(id=kind))


def packed_pieces(docs: DataFrame, tokenizer: str, length: int = 2048) -> DataFrame:
    """The pieces without their ids, but with a checksum of them."""
    found = pack(docs, tokenizer, length)
    return found.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
