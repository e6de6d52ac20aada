"""Op 11: tokens of two tokenizers over the same bytes, grouped between the places where both end.

The tokens of a batch of texts form two rising rows of byte ends. An interval of the first row looks for
an end that the second row has too, from its middle outwards, by binary search; where it finds one it is
divided there and both halves go on, and an interval without one stays a group. All intervals of a batch
are divided at the same time.

How many documents hold a pair of ids linked is counted over blocks of documents: a block sends each of
its distinct pairs once, and gets its count back once.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podlens.llm.arrow_text import cached, runs, slices, text_buffers
from podlens.llm.blobs import pack, pack_plain, unpack, unpack_plain
from podlens.llm.tables import prepare, store

BLOCK_BYTES = 4 << 20
# Pairs that are spread out at once; a larger group is reduced to its distinct ids first.
PAIRS_AT_ONCE = 4 << 20
# From this lead byte on (U+0540) the Unicode tables of the two byte-level encoders may differ.
FAR = re.compile(rb"[\xd5-\xff]")
# White space beside a space, or at an end.
CLOSE = re.compile(r"\s |^\s| \s|\s$")
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
PLAIN = re.compile(r"\S(.*\S)?\Z", re.S)
HELD_SEGMENTS, HELD_LENGTH, LEARN_AT_ONCE = 400_000, 64, 512
# Up to this many places around a middle are probed for all intervals at once; few are longer.
RING_COLUMNS = 64
# Bits of an id in a pair; 2 ** 16 documents of a batch fit before two of them.
PAIR_BITS = 20

_BLOCK = (
    "block long, doc_id array<{id}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, n_pairs array<long>, n_codes long, codes binary, docs binary, at binary, times binary"
)
_RESULT = (
    "doc_id {id}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)
_GROUP = "doc_id {id}, group long, start long, end long, a_ids array<int>, b_ids array<int>"


def byte_of_sign() -> dict[str, int]:
    """The signs that byte-level vocabularies write for bytes: visible ones as they are, others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [byte for byte in range(256) if byte not in set(visible)]
    return {chr(byte): byte for byte in visible} | {chr(256 + i): byte for i, byte in enumerate(hidden)}


class TokenizerPair:
    """Ids of a text by a byte-level vocabulary (A) and a piece vocabulary (B), and the bytes of each id."""

    def __init__(self, byte_level: str, piece_model: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(byte_level)
        self.whole.encode_special_tokens = True
        special = {token.content for token in self.whole.get_added_tokens_decoder().values()}
        signs = byte_of_sign()
        vocabulary = self.whole.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = token.encode() if token in special else bytes(signs[sign] for sign in token)
        ranks = {self.a_bytes[i]: i for token, i in vocabulary.items() if token not in special}
        self.near = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = SentencePieceProcessor(model_file=piece_model)
        self.b_bytes = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        # Merges stay within a part of a text if no piece holds a space behind anything else.
        self.by_space = not any(b" " in raw.lstrip(b" ") for raw in self.b_bytes)
        self.held: dict[str, tuple[bytes, bytes, bool]] = {}
        self.a_lengths = np.array([len(raw) for raw in self.a_bytes], np.int64)
        self.b_lengths = np.array([len(raw) for raw in self.b_bytes], np.int64)
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << PAIR_BITS:
            raise ValueError(f"a vocabulary has ids beyond {PAIR_BITS} bits")
        digits = [str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        # Up to seven digits and a sign behind them, in eight bytes.
        self.digits = np.array(digits, "S8").view("<u8").copy()
        self.n_digits = np.array([len(raw) for raw in digits], np.int64)
        self.shown = np.tri(9, 8, dtype=bool)

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        if self.pieces.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace("▁", " ").encode()

    def _first(self, text: str) -> np.ndarray:
        if FAR.search(text.encode()):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.near.encode_ordinary(text), "<u4")

    def _one(self, text: str) -> tuple[bytes, bytes, bool]:
        second = self.pieces.encode(text)
        same = b"".join(map(self.b_bytes.__getitem__, second)) == b" " + text.encode()
        return self._first(" " + text).tobytes(), np.array(second, "<u4").tobytes(), same

    def _learn(self, segments: list[str]) -> dict[str, tuple[bytes, bytes, bool]]:
        """Ids of segments (each behind a space) as bytes of 32-bit numbers, and whether B gives their bytes back.

        They are encoded as one text and cut where each ends.
        """
        joined = " " + " ".join(segments)
        raw = joined.encode()
        ends = np.cumsum([len(text.encode()) + 1 for text in segments])
        first, second = self._first(joined), np.array(self.pieces.encode(joined[1:]), "<u4")
        cuts = []
        for ids, lengths in ((first, self.a_lengths), (second, self.b_lengths)):
            reached = np.cumsum(lengths[ids])
            at = np.minimum(np.searchsorted(reached, ends), len(reached) - 1)
            if not np.array_equal(reached[at], ends):
                return {text: self._one(text) for text in segments}
            cuts.append([0, *(4 * (at + 1)).tolist()])
        if b"".join(map(self.b_bytes.__getitem__, second.tolist())) != raw:
            return {text: self._one(text) for text in segments}
        a, b = first.tobytes(), second.tobytes()
        spans = zip(*[zip(own, own[1:]) for own in cuts])
        return {text: (a[i:j], b[k:l], True) for text, ((i, j), (k, l)) in zip(segments, spans)}

    def _segments(self, text: str) -> list[str]:
        """Parts behind single spaces. No token of either vocabulary reaches over such a space from its left."""
        if not self.by_space or "▁" in text:
            return [text]
        return BETWEEN.split(text) if CLOSE.search(text) else text.split(" ")

    def encode(self, raws: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids by A and by B, as bytes; both empty where a text is empty or its tokens do not give its bytes back."""
        split = [self._segments(raw.decode()) if raw else [] for raw in raws]
        if len(self.held) > HELD_SEGMENTS:
            self.held.clear()
        new = set().union(*split).difference(self.held)
        plain = [text for text in new if len(text) <= HELD_LENGTH and PLAIN.match(text) and "▁" not in text]
        long = {text: self._one(text) for text in new.difference(plain)}
        for first in range(0, len(plain), LEARN_AT_ONCE):
            self.held.update(self._learn(plain[first : first + LEARN_AT_ONCE]))
        out = []
        for raw, segments in zip(raws, split):
            found = [self.held.get(text) or long[text] for text in segments]
            first, second = b"".join([x[0] for x in found]), b"".join([x[1] for x in found])
            if not all([x[2] for x in found]):
                bytes_ = b"".join(map(self.b_bytes.__getitem__, np.frombuffer(second, "<u4").tolist()))
                first, second = (first, second) if bytes_ == b" " + raw else (b"", b"")
            out.append((first, second))
        return out


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Which ends of A are ends of B too. Both rise, and end with the same value."""
    cut = np.zeros(len(a_ends), bool)
    if not len(a_ends):
        return cut
    cut[-1] = True
    low, high = np.array([0]), np.array([len(a_ends) - 1])
    while len(low):
        open_ = high > low
        low, high = low[open_], high[open_]
        found = (low + high) // 2
        probed = a_ends[found]
        missed = np.flatnonzero(b_ends[np.searchsorted(b_ends, probed)] != probed)
        found[missed] = _nearest(a_ends, b_ends, low[missed], high[missed])
        split = found >= 0
        low, high, found = low[split], high[split], found[split]
        cut[found] = True
        # Halves stay in the order of the text.
        low = np.stack([low, found + 1], 1).ravel()
        high = np.stack([found, high], 1).ravel()
    return cut


def _nearest(a_ends: np.ndarray, b_ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each interval the shared end nearest to its middle, beside the middle itself, or -1."""
    middle = (low + high) // 2
    found = np.full(len(low), -1)
    waiting, done = np.arange(len(low)), 0
    while len(waiting):
        # Rings of doubling width: up to ``reach`` places on either side that were not looked at yet.
        reach = 2 * done + 1
        at, own_low, own_high = middle[waiting], low[waiting], high[waiting]
        steps = np.concatenate([np.arange(-reach, -done), np.arange(done + 1, reach + 1)])
        steps = steps[np.argsort(np.abs(steps), kind="stable")]
        if len(steps) <= RING_COLUMNS:
            probe = at[:, None] + steps
            inside = (probe >= own_low[:, None]) & (probe < own_high[:, None])
            ends = a_ends[np.where(inside, probe, at[:, None])]
            hit = inside & (b_ends[np.searchsorted(b_ends, ends)] == ends)
            first = hit.argmax(1)
            better = hit[np.arange(len(at)), first]
            found[waiting[better]] = probe[better, first[better]]
        else:
            for i, place in zip(waiting.tolist(), at.tolist()):
                probe = place + steps
                probe = probe[(probe >= low[i]) & (probe < high[i])]
                ends = a_ends[probe]
                hit = np.flatnonzero(b_ends[np.searchsorted(b_ends, ends)] == ends)
                found[i] = probe[hit[0]] if len(hit) else -1
        exhausted = (at - reach <= own_low) & (at + reach >= own_high - 1)
        waiting, done = waiting[(found[waiting] < 0) & ~exhausted], reach
    return found


class Alignment:
    """Groups of a batch of texts: their sizes in tokens of A and B, and the document of each."""

    def __init__(self, pair: TokenizerPair, raws: list[bytes]):
        self.pair = pair
        found = pair.encode(raws)
        self.n_a = np.array([len(first) // 4 for first, _ in found], np.int64)
        self.n_b = np.array([len(second) // 4 for _, second in found], np.int64)
        self.a = np.frombuffer(b"".join([first for first, _ in found]), "<u4").astype(np.int64)
        self.b = np.frombuffer(b"".join([second for _, second in found]), "<u4").astype(np.int64)
        # Documents lie one after the other, so the end of each is an end of both rows.
        self.a_ends, self.b_ends = np.cumsum(pair.a_lengths[self.a]), np.cumsum(pair.b_lengths[self.b])
        a_cuts = np.flatnonzero(shared_cuts(self.a_ends, self.b_ends))
        self.ends = self.a_ends[a_cuts]
        self.a_last = a_cuts + 1
        self.b_last = np.searchsorted(self.b_ends, self.ends) + 1
        self.a_size, self.b_size = np.diff(self.a_last, prepend=0), np.diff(self.b_last, prepend=0)
        self.first_a = np.concatenate([[0], np.cumsum(self.n_a)])
        self.doc = np.searchsorted(self.first_a, a_cuts, "right") - 1
        self.n_groups = np.bincount(self.doc, minlength=len(raws))
        self.n_links = np.zeros(len(raws), np.int64)
        np.add.at(self.n_links, self.doc, self.a_size * self.b_size)

    def written(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for each document."""
        n = len(self.a_size)
        group_a, group_b = np.repeat(np.arange(n), self.a_size), np.repeat(np.arange(n), self.b_size)
        before_b, before_a = self.b_last - self.b_size, self.a_last
        at_a = np.arange(len(self.a)) + before_b[group_a]
        at_b = np.arange(len(self.b)) + before_a[group_b]
        ids, sign = np.zeros(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        sign[at_a[self.a_last - 1]] = ord("|")
        sign[at_b[self.b_last - 1]] = ord(";")
        lengths = self.pair.n_digits[ids]
        signs = self.pair.digits[ids] | sign.astype(np.uint64) << (8 * lengths).astype(np.uint64)
        flat = signs.view(np.uint8)[self.pair.shown[lengths].ravel()].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths + 1)])[np.cumsum(self.n_a + self.n_b)]
        starts = np.concatenate([[0], ends[:-1]])
        return [flat[a : max(a, b - 1)] for a, b in zip(starts.tolist(), ends.tolist())]

    def _links(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Document and pair of the links of the groups from ``first`` to ``last`` in one number, and their times."""
        a_size, b_size = self.a_size[first:last], self.b_size[first:last]
        a_from, b_from = (self.a_last - self.a_size)[first:last], (self.b_last - self.b_size)[first:last]
        doc = self.doc[first:last] << 2 * PAIR_BITS
        if last - first == 1 and a_size[0] * b_size[0] > PAIRS_AT_ONCE:
            a, a_times = np.unique(self.a[a_from[0] :][: a_size[0]], return_counts=True)
            b, b_times = np.unique(self.b[b_from[0] :][: b_size[0]], return_counts=True)
            return (doc[0] | a[:, None] << PAIR_BITS | b).ravel(), (a_times[:, None] * b_times).ravel()
        links = a_size * b_size
        nth, width = runs(links), np.repeat(b_size, links)
        down = nth // width
        a, b = np.repeat(a_from, links) + down, np.repeat(b_from, links) + nth - down * width
        return np.repeat(doc, links) | self.a[a] << PAIR_BITS | self.b[b], None

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each document, by document and pair, with the number of their links."""
        parts, first = [], 0
        before = np.concatenate([[0], np.cumsum(self.a_size * self.b_size)])
        while first < len(self.a_size):
            last = max(first + 1, int(np.searchsorted(before, before[first] + PAIRS_AT_ONCE, "right")) - 1)
            parts.append(_summed(*self._links(first, last)))
            first = last
        keys, times = parts[0] if len(parts) == 1 else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(parts) > 1:
            keys, times = _summed(*(np.concatenate(columns) for columns in zip(*parts)))
        return keys >> 2 * PAIR_BITS, keys & ((1 << 2 * PAIR_BITS) - 1), times


def _summed(keys: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if times is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    if times is None:
        return keys[first], np.diff(first, append=len(keys))
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def _batches(pair: Callable[[], TokenizerPair], batch: pa.RecordBatch) -> Iterator[tuple[int, int, Alignment]]:
    data, offsets = text_buffers(batch["text"])
    raw = data.tobytes()
    for first, last in slices(offsets, BLOCK_BYTES):
        at = offsets[first : last + 1].tolist()
        yield first, last, Alignment(pair(), [raw[a:b] for a, b in zip(at, at[1:])])


def _holder(byte_level: str, piece_model: str, pattern: str) -> Callable[[], TokenizerPair]:
    return lambda: cached(f"pair {byte_level} {piece_model}", lambda: TokenizerPair(byte_level, piece_model, pattern))


def aligned_groups(docs: DataFrame, byte_level: str, piece_model: str, pattern: str) -> DataFrame:
    """A row for each group: its bytes in space and text, and the ids of both tokenizers."""
    prepare(docs.sparkSession)
    pair = _holder(byte_level, piece_model, pattern)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, found in _batches(pair, batch):
                sizes = found.ends - np.concatenate([[0], found.ends[:-1]])[: len(found.ends)]
                doc_ends = np.concatenate([[0], found.a_ends])[found.first_a]
                end = found.ends - doc_ends[found.doc]
                lists = [
                    pa.ListArray.from_arrays(np.append(0, last).astype(np.int32), pa.array(ids, pa.int32()))
                    for last, ids in ((found.a_last, found.a), (found.b_last, found.b))
                ]
                columns = [runs(found.n_groups), end - sizes, end]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(first + found.doc)), *map(pa.array, columns), *lists],
                    names=["doc_id", "group", "start", "end", "a_ids", "b_ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(groups, _GROUP.format(id=kind))


def _blocks(docs: DataFrame, pair: Callable[[], TokenizerPair]) -> DataFrame:
    """A row for each block of documents: their figures, and their pairs as places among the block's own."""

    def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for first, last, found in _batches(pair, batch):
                doc, codes, times = found.pairs()
                distinct, at, docs_of = np.unique(codes, return_inverse=True, return_counts=True)
                n_pairs = np.bincount(doc, minlength=last - first)
                digests = [hashlib.sha256(text).hexdigest() if text else "" for text in found.written()]
                ids = batch["doc_id"].slice(first, last - first)
                lists = [ids, found.n_a, found.n_b, found.n_groups, found.n_links, digests, n_pairs]
                whole = pa.array([0, last - first], pa.int32())
                blobs = [
                    pack(distinct),
                    pack_plain(docs_of.astype(np.uint32)),
                    pack_plain(at.astype(np.uint32)),
                    pack_plain(times.astype(np.uint64)),
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(batch["part"][0].as_py() << 32) + number]),
                        *[pa.ListArray.from_arrays(whole, x if isinstance(x, pa.Array) else pa.array(x)) for x in lists],
                        pa.array([len(distinct)]),
                        *[pa.array([blob], pa.binary()) for blob in blobs],
                    ],
                    names=[field.split()[0] for field in _BLOCK.split(", ")],
                )
                number += 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.spark_partition_id().alias("part"))
    return rows.mapInArrow(block_rows, _BLOCK.format(id=kind))


def _distinct_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, n, codes, docs in zip(*(batch[name].to_pylist() for name in batch.schema.names)):
            columns = [np.full(n, block), unpack(codes, n).astype(np.int64), unpack_plain(docs, n, np.uint32)]
            for first in range(0, n, 1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[first : first + (1 << 16)].astype(np.int64)) for x in columns],
                    names=["block", "pair", "n_docs"],
                )


def _judged(blocks: pa.Table, answers: pa.Table) -> pa.Table:
    """Figures of the documents of one block, with the counts of its pairs."""
    order = np.argsort(answers["pair"].to_numpy())
    n_docs, best = answers["n_docs"].to_numpy()[order], answers["best"].to_numpy(zero_copy_only=False)[order]
    columns = {name: blocks[name].combine_chunks().flatten() for name in blocks.schema.names if _is_list(blocks, name)}
    n_pairs = columns.pop("n_pairs").to_numpy()
    total = int(n_pairs.sum())
    at = unpack_plain(blocks["at"][0].as_py(), total, np.uint32)
    times = unpack_plain(blocks["times"][0].as_py(), total, np.uint64).astype(np.int64)
    ends = np.cumsum(n_pairs)
    for name, values in (("n_best", times * best[at]), ("count_sum", times * n_docs[at])):
        sums = np.concatenate([[0], np.cumsum(values)])
        columns[name] = pa.array((sums[ends] - sums[ends - n_pairs]).astype(np.int64))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return pa.table([columns[name] for name in names], names=names)


def _is_list(table: pa.Table, name: str) -> bool:
    return pa.types.is_list(table.schema.field(name).type)


def align(docs: DataFrame, byte_level: str, piece_model: str, pattern: str) -> DataFrame:
    """Per document: tokens, groups, links, and how common its links are in all documents.

    ``docs`` has ``doc_id`` and ``text``; other columns are not read. A text that is null or empty, or that
    one of the tokenizers does not give back byte for byte, has no tokens: zeros, and '' as digest. Every
    row is a document of its own, also where ids or texts repeat or the id is null. Pairs that tie for the
    highest count of an A id all count as best. An empty table gives no rows. ``pattern`` splits texts
    before the merges of the byte-level vocabulary.
    """
    prepare(docs.sparkSession)
    blocks = store(_blocks(docs, _holder(byte_level, piece_model, pattern)), "aligned", "zstd")
    packed = blocks.select("block", "n_codes", "codes", "docs")
    pairs = packed.mapInArrow(_distinct_pairs, "block long, pair long, n_docs long")
    counts = store(pairs.groupBy("pair").agg(F.sum("n_docs").alias("n_docs")), "pairs")
    # One row for each A id, of which a vocabulary has a fixed number.
    first = F.shiftright("pair", PAIR_BITS).alias("a_id")
    highest = counts.groupBy(first).agg(F.max("n_docs").alias("highest"))
    ranked = counts.select("*", first).join(F.broadcast(highest), "a_id")
    ranked = ranked.select("pair", "n_docs", (F.col("n_docs") == F.col("highest")).alias("best"))
    answers = pairs.select("block", "pair").join(ranked, "pair")
    kind = docs.schema["doc_id"].dataType.simpleString()
    left = blocks.drop("codes", "docs", "n_codes").groupBy("block")
    return left.cogroup(answers.groupBy("block")).applyInArrow(_judged, _RESULT.format(id=kind))
