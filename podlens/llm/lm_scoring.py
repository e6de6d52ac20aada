"""Op 6: text scores by context-tree weighting (CTW) over bytes.

The bits of a byte are predicted one after the other, each by a context tree of the preceding bytes.
Every node of a tree has a Krichevsky-Trofimov (KT) estimate of its training bits; a node's weighted
probability is half its own estimate and half the product of its children's. The predictive
probability mixes the estimates of all depths on a text's path by these weights.

1. Blocks of documents send the buckets their distinct pairs of context and byte, with training counts.
   Contexts are dealt by their last two bytes, so a bucket holds whole subtrees from depth 2 on. Crowded
   buckets are dealt once more, by the last three bytes, and hold subtrees from depth 3 on.
2. Buckets weigh their subtrees, a few at a time; what depths 0 and 1 need (at most 256 x 255 nodes), and
   depth 2 in crowded buckets, is summed over all.
3. Buckets answer each block with the log probability of each of its pairs, and the blocks add them up.

A word unigram model with the same training documents is counted in the same exchange, as a baseline.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podlens.llm.arrow_text import Words, cached, mix, runs, slices, text_buffers
from podlens.llm.blobs import pack, pack_plain, unpack, unpack_plain
from podlens.llm.tables import blocked, pieces, prepare, scattered, store, text_bytes

DEPTH = 6
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
SLICE = 1 << 20
# Buckets with more keys than this, over all blocks, are dealt once more, by the last three bytes.
BUCKET_KEYS = 4_000_000
# Subtrees are weighed so many distinct keys at a time, and keys of blocks merged so many at a time.
TREE_KEYS, MERGE_KEYS = 400_000, 4_000_000
END = 10

_ASK = "kind string, block int, bucket int, n int, keys binary, counts binary"
_NODES = "depth int, context int, prefix int, zeros long, ones long, weighted double"
_DEALT = f"{_ASK}, sub int"
_ANSWER = "block int, kind string, bucket int, sub int, n int, values binary, distinct long, total long"
_TYPES = {"i": pa.int32(), "l": pa.int64(), "b": pa.binary(), "s": pa.string(), "d": pa.float64()}
_ANSWER_NAMES = ["block", "kind", "bucket", "sub", "n", "values", "distinct", "total"]


def _table(rows: list[tuple], names: list[str], kinds: str) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table([pa.array(c, _TYPES[k]) for c, k in zip(columns, kinds)], names=names)


class Stream:
    """Texts as bytes: words in lower case (A-Z), a space after each but the last, and an end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.words = words = Words(data, offsets)
        empty = np.flatnonzero(words.counts == 0)
        doc = np.concatenate([words.doc, empty])
        order = np.argsort(doc, kind="stable")
        doc = doc[order]
        sources = np.concatenate([words.starts, np.zeros(len(empty), np.int64)])[order]
        lengths = np.concatenate([words.ends - words.starts, np.zeros(len(empty), np.int64)])[order]
        starts = np.cumsum(lengths + 1) - lengths - 1
        self.bytes = np.full(int((lengths + 1).sum()), 32, np.uint8)
        place = runs(lengths)
        self.bytes[np.repeat(starts, lengths) + place] = data[np.repeat(sources, lengths) + place]
        last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
        self.bytes[(starts + lengths)[last]] = END
        first = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
        self.first = np.append(starts[first], len(self.bytes))

    def keys(self) -> np.ndarray:
        """The context of each byte, last byte first, and the byte itself; before a text stand ends."""
        doc = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        place = np.arange(len(self.bytes)) + DEPTH * (doc + 1)
        padded = np.full(len(self.bytes) + DEPTH * len(self.first) + 8, END, np.uint8)
        padded[place] = self.bytes
        # Eight bytes from each place on as one number, of which the first DEPTH count; the last is highest.
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        before = eight[place - DEPTH] & np.uint64((1 << 8 * DEPTH) - 1)
        return before.astype(np.uint64) << np.uint64(8) | self.bytes


def _streams(table: pa.Table):
    data, offsets = text_buffers(table["text"])
    held_out = table["held_out"].to_numpy()
    for first, last in slices(offsets, SLICE):
        bounds = offsets[first : last + 1]
        yield first, last, Stream(data[bounds[0] : bounds[-1]], bounds - bounds[0]), ~held_out[first:last]


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts of each."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = (np.concatenate(column) for column in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _trained(keys: np.ndarray, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (below 2^63) and how often each occurs where ``training`` holds."""
    codes = np.sort((keys << np.uint64(1)) | training.astype(np.uint64))
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(codes)))
    codes = codes[starts]
    return codes >> np.uint64(1), np.where(codes & np.uint64(1), counts, 0).astype(np.int64)


def _word_keys(words: Words) -> np.ndarray:
    return words.hashes() >> np.uint64(1)


def block_keys(table: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of a block: distinct context pairs and words, with their training counts."""
    contexts, words = [], []
    for _, _, stream, training in _streams(table):
        contexts.append(_counted([_trained(stream.keys(), np.repeat(training, np.diff(stream.first)))]))
        words.append(_counted([_trained(_word_keys(stream.words), training[stream.words.doc])]))
    return {"context": _counted(contexts), "word": _counted(words)}


def _buckets(kind: str, keys: np.ndarray, n: int) -> np.ndarray:
    """Contexts go by their last two bytes, words by themselves."""
    part = keys >> np.uint64(8 * (DEPTH - 1)) if kind == "context" else keys
    return (mix(part, 21) % np.uint64(n)).astype(np.int64)


def _dealt(kind: str, keys: np.ndarray, n: int):
    """For each bucket the places of its keys, in order."""
    bucket = _buckets(kind, keys, n)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            yield k, order[a:b]


def _parts(keys: np.ndarray, n: int):
    """For each part of a crowded bucket the places of its keys, in order; contexts go by their last three bytes."""
    part = (mix(keys >> np.uint64(8 * (DEPTH - 2)), 22) % np.uint64(n)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(n + 1))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            yield k, order[a:b]


def _deal_again(crowded: dict[int, int]):
    """Rows of crowded buckets, split into as many parts as are given for each."""

    def deal_again(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = unpack(row["keys"], row["n"]), unpack_plain(row["counts"], row["n"], np.int64)
                rows = [
                    ("context", row["block"], row["bucket"], len(at), pack(keys[at]), pack_plain(counts[at]), sub)
                    for sub, at in _parts(keys, crowded[row["bucket"]])
                ]
                names = ["kind", "block", "bucket", "n", "keys", "counts", "sub"]
                yield from _table(rows, names, "siiibbi").to_batches()

    return deal_again


def _ask(n_buckets: int):
    def ask(key, table):
        rows = []
        for kind, (keys, counts) in block_keys(table).items():
            for bucket, at in _dealt(kind, keys, n_buckets):
                rows.append((kind, key[0].as_py(), bucket, len(at), pack(keys[at]), pack_plain(counts[at])))
        return _table(rows, ["kind", "block", "bucket", "n", "keys", "counts"], "siiibb")

    return ask


def _log_gammas() -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of gamma(n + 1/2) and gamma(n + 1) for small n."""
    n = np.arange(1 << 14)
    half = 0.5 * np.log(np.pi) + np.concatenate([[0], np.cumsum(np.log(n[:-1] + 0.5))])
    return half, np.concatenate([[0], np.cumsum(np.log(n[1:]))])


def _log_gamma(n: np.ndarray, half: bool) -> np.ndarray:
    table = cached("log gammas", _log_gammas)[0 if half else 1]
    small = table[np.minimum(n, len(table) - 1).astype(np.int64)]
    x = np.maximum(n + (0.5 if half else 1.0), 1000.0)
    large = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < len(table), small, large)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the KT probability of any sequence with so many zeros and ones."""
    return _log_gamma(zeros, True) + _log_gamma(ones, True) - _log_gamma(zeros + ones, False) - np.log(np.pi)


def weigh(estimate: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Log weighted probability of nodes: half the estimate, half the product of the children's."""
    return np.logaddexp(estimate, children) - np.log(2)


class Subtrees:
    """The context trees of some pairs, from DEPTH up to depth ``top``, and the mix of their estimates there.

    Arrays have a row for each bit of a byte and a column for each pair.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, top: int):
        byte = (keys & np.uint64(255)).astype(np.int64)
        bits = np.arange(8)[:, None]
        self.prefix = (1 << bits) | (byte >> (8 - bits))
        self.bit = (byte >> (7 - bits)) & 1
        context = keys >> np.uint64(8)
        below = None
        for depth in range(DEPTH, top - 1, -1):
            node = ((context >> np.uint64(8 * (DEPTH - depth))) << np.uint64(8)) | self.prefix.astype(np.uint64)
            every, first, inverse = np.unique(node, return_index=True, return_inverse=True)
            inverse = inverse.reshape(node.shape)
            weights = np.broadcast_to(counts, node.shape)
            ones = np.bincount(inverse.ravel(), (weights * self.bit).ravel(), len(every))
            zeros = np.bincount(inverse.ravel(), weights.ravel(), len(every)) - ones
            estimate = log_kt(zeros, ones)
            own = np.where(self.bit, ones[inverse] + 0.5, zeros[inverse] + 0.5) / (zeros + ones + 1)[inverse]
            if below is None:
                weighted, self.mixed = estimate, own
            else:
                parent = inverse.ravel()[below[1]]
                weighted = weigh(estimate, np.bincount(parent, below[0], len(every)))
                share = np.exp(estimate - np.log(2) - weighted)[inverse]
                self.mixed = share * own + (1 - share) * self.mixed
            below = weighted, first
        self.nodes, self.zeros, self.ones, self.weighted = every, zeros, ones, weighted


def _subtrees(keys: np.ndarray, counts: np.ndarray, top: int):
    """Subtrees from depth ``top`` on, a few at a time, and the places of their keys."""
    context = keys >> np.uint64(8 * (DEPTH - top + 1))
    starts = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(keys))
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + TREE_KEYS, side="right")))
        a, b = int(starts[first]), int(ends[last - 1])
        yield a, b, Subtrees(keys[a:b], counts[a:b], top)
        first = last


def _gathered(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """In a bucket: distinct keys, in order, and their counts over all blocks."""
    parts, held = [], 0
    for row in rows:
        parts.append((unpack(row["keys"], row["n"]), unpack_plain(row["counts"], row["n"], np.int64)))
        held += row["n"]
        if held > MERGE_KEYS + len(parts[0][0]):
            parts = [_counted(parts)]
            held = len(parts[0][0])
    return _counted(parts)


def _upper_nodes(crowded: dict[int, int]):
    """Of a bucket's depth 2 nodes the sums by last byte and bit prefix; if crowded, of depth 3 by last two bytes."""

    def upper_nodes(key, table):
        top = 3 if key[0].as_py() in crowded else 2
        parts = []
        for _, _, trees in _subtrees(*_gathered(table.to_pylist()), top):
            upper = (trees.nodes >> np.uint64(16) << np.uint64(8)) | (trees.nodes & np.uint64(255))
            every, inverse = np.unique(upper, return_inverse=True)
            sums = [np.bincount(inverse, v, len(every)) for v in (trees.zeros, trees.ones, trees.weighted)]
            parts.append((every, *sums))
        upper, zeros, ones, weighted = (np.concatenate(column) for column in zip(*parts))
        every, inverse = np.unique(upper, return_inverse=True)
        zeros, ones, weighted = (np.bincount(inverse, v, len(every)) for v in (zeros, ones, weighted))
        context, prefix = (every >> np.uint64(8)).astype(np.int32), (every & np.uint64(255)).astype(np.int32)
        depth = np.full(len(every), top - 1, np.int32)
        columns = [depth, context, prefix, zeros.astype(np.int64), ones.astype(np.int64), weighted]
        names = ["depth", "context", "prefix", "zeros", "ones", "weighted"]
        return pa.table([pa.array(c) for c in columns], names=names)

    return upper_nodes


class UpperLevels:
    """Estimates and weights of depths 0 and 1, by last byte and bit prefix, and of depth 2 in crowded buckets."""

    def __init__(self, rows):
        shape = (256, 256)
        zeros, ones, below = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        for row in rows:
            if row["depth"] == 1:
                at = row["context"], row["prefix"]
                zeros[at], ones[at], below[at] = row["zeros"], row["ones"], row["weighted"]
        crowded = [row for row in rows if row["depth"] == 2]
        pairs = sorted((r["context"] << 8 | r["prefix"], r["zeros"], r["ones"], r["weighted"]) for r in crowded)
        pairs = np.array(pairs, float).reshape(-1, 4)
        self.pairs = pairs[:, 0].astype(np.int64)
        estimate = log_kt(pairs[:, 1], pairs[:, 2])
        weighted = weigh(estimate, pairs[:, 3])
        self.pair_ones = (pairs[:, 2] + 0.5) / (pairs[:, 1] + pairs[:, 2] + 1)
        self.pair_share = np.exp(estimate - np.log(2) - weighted)
        at = self.pairs >> 16, self.pairs & 255
        for sums, values in ((zeros, pairs[:, 1]), (ones, pairs[:, 2]), (below, weighted)):
            np.add.at(sums, at, values)
        estimate = log_kt(zeros, ones)
        weighted = weigh(estimate, below)
        self.ones = (ones + 0.5) / (zeros + ones + 1)
        self.share = np.exp(estimate - np.log(2) - weighted)
        zeros, ones, below = zeros.sum(axis=0), ones.sum(axis=0), weighted.sum(axis=0)
        estimate = log_kt(zeros, ones)
        self.top_ones = (ones + 0.5) / (zeros + ones + 1)
        self.top_share = np.exp(estimate - np.log(2) - weigh(estimate, below))

    def log10(self, trees: Subtrees, keys: np.ndarray, top: int) -> np.ndarray:
        """Log10 probability of each pair's byte after its context."""
        below = trees.mixed
        if top == 3:
            pair = (keys >> np.uint64(8 * (DEPTH - 1))).astype(np.int64)
            at = np.searchsorted(self.pairs, pair << 8 | trees.prefix)
            own = np.where(trees.bit, self.pair_ones[at], 1 - self.pair_ones[at])
            below = self.pair_share[at] * own + (1 - self.pair_share[at]) * below
        last = np.broadcast_to((keys >> np.uint64(8 * DEPTH)).astype(np.int64), trees.prefix.shape)
        at = last, trees.prefix
        own = np.where(trees.bit, self.ones[at], 1 - self.ones[at])
        mixed = self.share[at] * own + (1 - self.share[at]) * below
        top = np.where(trees.bit, self.top_ones[trees.prefix], 1 - self.top_ones[trees.prefix])
        share = self.top_share[trees.prefix]
        return np.log10(share * top + (1 - share) * mixed).sum(axis=0)


def _answer(levels: UpperLevels, crowded: dict[int, int]):
    def answer(key, table):
        kind, bucket, sub = (part.as_py() for part in key)
        rows = table.to_pylist()
        keys, counts = _gathered(rows)
        values = counts
        if kind == "context":
            top = 3 if bucket in crowded else 2
            trees = _subtrees(keys, counts, top)
            found = [levels.log10(tree, keys[a:b], top).astype(np.float32) for a, b, tree in trees]
            values = np.concatenate(found) if found else np.zeros(0, np.float32)
        # Block -1: what the model as a whole needs.
        out = [(-1, kind, bucket, sub, 0, b"", int((counts > 0).sum()), int(counts.sum()))]
        for row in rows:
            own = pack_plain(values[np.searchsorted(keys, unpack(row["keys"], row["n"]))])
            out.append((row["block"], kind, bucket, sub, row["n"], own, 0, 0))
        return _table(out, _ANSWER_NAMES, "isiiibll")

    return answer


def _answered(
    kind: str, keys: np.ndarray, rows: list[dict], n_buckets: int, dtype, crowded: dict[int, int]
) -> np.ndarray:
    """The answers for all keys of a block, in order of the keys."""
    values = np.zeros(len(keys), dtype)
    found = {(row["bucket"], row["sub"]): row for row in rows if row["kind"] == kind}
    for bucket, at in _dealt(kind, keys, n_buckets):
        whole = kind != "context" or bucket not in crowded
        for sub, own in [(0, slice(None))] if whole else _parts(keys[at], crowded[bucket]):
            values[at[own]] = unpack_plain(found[bucket, sub]["values"], len(at[own]), dtype)
    return values


class Lookup:
    """Places of many keys in a sorted table: by a table of hashes first, and by search for the rest."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(8, int(len(keys)).bit_length() + 3)
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        place = self.slots[self._slot(keys)]
        missed = np.flatnonzero(self.keys[place] != keys)
        place[missed] = np.searchsorted(self.keys, keys[missed])
        return place


def _score(n_buckets: int, crowded: dict[int, int], train_tokens: int, n_distinct: int, end_count: int):
    def score(key, docs, answers):
        rows = answers.to_pylist()
        found = block_keys(docs)
        log_probability = _answered("context", found["context"][0], rows, n_buckets, np.float32, crowded)
        counts = _answered("word", found["word"][0], rows, n_buckets, np.int64, crowded)
        log_probability = log_probability.astype(np.float64)
        contexts, words = Lookup(found["context"][0]), Lookup(found["word"][0])
        denominator = train_tokens + 0.5 * (n_distinct + 1)
        word_scores = np.log10((counts + 0.5) / denominator)
        end_score = float(np.log10((end_count + 0.5) / denominator))
        parts = []
        for _, _, stream, _ in _streams(docs):
            n = len(stream.words.counts)
            values = log_probability[contexts.find(stream.keys())]
            place = words.find(_word_keys(stream.words))
            doc = stream.words.doc
            known = np.bincount(doc, counts[place] > 0, n).astype(np.int64) + (end_count > 0)
            base = np.bincount(doc, word_scores[place], n) + end_score
            parts.append((stream.words.counts + 1, known, base, np.add.reduceat(values, stream.first[:-1])))
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [[], [], [], []]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        columns = [pa.array(c, k) for c, k in zip(columns, kinds)]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        return pa.table([docs["doc_id"], docs["held_out"], *columns], names=names)

    return score


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """Scores of all documents by a model of those that are not ``held_out``.

    Returns ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (word
    unigrams), ``score`` (log10 of the CTW probability of the text's bytes, from its words in lower
    case to its end). ``docs`` has ``doc_id`` and ``text``; other columns are not
    read. A null or empty text is its end alone. Rows that repeat are counted each. A null ``held_out``
    counts as false. Without training documents all estimates are even. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    n_bytes = text_bytes(docs)
    n_blocks, n_buckets = pieces(n_bytes, BLOCK_BYTES, 4), pieces(n_bytes, BUCKET_BYTES, 4)
    kind = docs.schema["doc_id"].dataType.simpleString()
    flag = F.coalesce(held_out, F.lit(False))
    spread = F.xxhash64("doc_id", F.substring("text", 1, 64))
    table = blocked(docs, ["doc_id", "text", flag.alias("held_out")], scattered(spread, n_blocks), n_blocks)
    by_block = table.groupBy("block")
    asked = store(by_block.applyInArrow(_ask(n_buckets), _ASK), "contexts")
    sizes = asked.filter("kind = 'context'").groupBy("bucket").agg(F.sum("n").alias("n"))
    # One row for each crowded bucket, of which there is at most one for BUCKET_KEYS keys.
    sizes = sizes.filter(F.col("n") > BUCKET_KEYS).collect()
    crowded = {row["bucket"]: -(-row["n"] // BUCKET_KEYS) for row in sizes}
    if crowded:
        again = (F.col("kind") == "context") & F.col("bucket").isin(list(crowded))
        split = asked.filter(again).mapInArrow(_deal_again(crowded), _DEALT)
        asked = asked.filter(~again).withColumn("sub", F.lit(0)).unionByName(store(split, "crowded-contexts"))
    else:
        asked = asked.withColumn("sub", F.lit(0))
    by_part = asked.filter("kind = 'context'").groupBy("bucket", "sub")
    upper = by_part.applyInArrow(_upper_nodes(crowded), _NODES)
    # At most 256 x 255 rows, and as many for each 256 pairs in crowded buckets.
    upper = upper.groupBy("depth", "context", "prefix").agg(*[F.sum(name).alias(name) for name in ("zeros", "ones", "weighted")])
    levels = UpperLevels(upper.collect())
    answers = store(asked.groupBy("kind", "bucket", "sub").applyInArrow(_answer(levels, crowded), _ANSWER), "answers")
    end_count = table.filter("not held_out").count()
    model = answers.filter("block = -1 and kind = 'word'").agg(F.sum("total"), F.sum("distinct")).first()
    train_tokens = (model[0] or 0) + end_count
    n_distinct = (model[1] or 0) + (end_count > 0)
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    own = answers.filter("block >= 0").select("block", "kind", "bucket", "sub", "values")
    scored = by_block.cogroup(own.groupBy("block")).applyInArrow(
        _score(n_buckets, crowded, train_tokens, n_distinct, end_count), schema
    )
    return scored.withColumn("train_tokens", F.lit(train_tokens).cast("long"))
