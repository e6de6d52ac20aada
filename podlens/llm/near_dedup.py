"""Op 7: near duplicates by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

1. Equal texts become one representative.
2. Blocks of representatives ask buckets for the document frequency of their shingles.
3. Each representative gets weights (term frequency times a damped inverse document frequency) and a
   signature of consistent weighted samples, cut into bands.
4. Representatives that share a band are compared, first by signature, then by the weighted Jaccard
   similarity of their shingles. A band's members meet over some representatives of it (hubs), in
   rounds with more and more hubs, until all members are in one class or have been hubs. So no pair
   of a band is left out unless both are in one class already. Bands with many members are compared
   in cells of two chunks of members each, which report no more links than join their members.
5. Links join into classes, each named by its smallest document id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podlens.llm.arrow_text import Words, cached, mix, slices, text_buffers, windows
from podlens.llm.blobs import deal, pack, pack_plain, unpack, unpack_plain
from podlens.llm.merkle import ranked
from podlens.llm.tables import blocked, pieces, prepare, scattered, store, text_bytes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
# Two signatures of texts at the threshold agree in 29 of 36 samples on average; 20 is almost 4 deviations less.
LEAST_AGREEMENT = 20
# Hubs of a band in the first round, and how many times as many there are in each further one.
FIRST_HUBS, MORE_HUBS = 2, 8
# Buckets with more members than this are compared in cells, of chunks of about so many members.
LARGE_BUCKET, CHUNK = 64, 1000
# How much a rare shingle outweighs one that all documents have. A strong weight would put copies,
# which make their own shingles frequent, below the threshold.
RARITY = 0.1
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
HASH_BITS = 48

_ASK = "block int, bucket int, n int, hashes binary, counts binary"
_ANSWER = "block int, bucket int, n int, counts binary"
_SIGNED = "doc long, signature array<long>, bands array<long>"
_WEIGHED = "doc long, n int, shingles binary, weights binary"


def _sampling_tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the gamma(2, 1) distribution for 16 random bits, and their logarithms."""
    target = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros(1 << 16), np.full(1 << 16, 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - np.exp(-middle) * (1 + middle) < target
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    gamma = (low + high) / 2
    return gamma.astype(np.float32), np.log(gamma).astype(np.float32)


def signatures(shingles: np.ndarray, weights: np.ndarray, first: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """One row of ``samples`` consistent weighted samples per document; documents lie one after the other.

    For each sample every shingle draws r and c from gamma(2, 1) and b from (0, 1); with
    t = floor(ln w / r + b) the shingle of the smallest c / exp(r (t - b) + r) is sampled, with its t.
    """
    gamma, log_gamma = cached("gamma tables", _sampling_tables)
    starts, n = first[:-1], len(first) - 1
    log_weights = np.log(weights).astype(np.float32)
    lengths = np.diff(first)
    out = np.zeros((n, samples), np.int64)
    if not len(shingles):
        return out
    for k in range(samples):
        bits = mix(shingles, 100 + k)
        r = gamma[(bits & np.uint64(0xFFFF)).astype(np.int64)]
        log_c = log_gamma[((bits >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)]
        b = ((bits >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.float32) / np.float32(1 << 16)
        t = np.floor(log_weights / r + b)
        log_a = log_c - r * (t - b + 1)
        smallest = np.minimum.reduceat(log_a, starts)
        hits = np.flatnonzero(log_a == np.repeat(smallest, lengths))
        # Of equal values the shingle with the smallest hash counts, so that order does not matter.
        doc = np.repeat(np.arange(n), lengths)[hits]
        order = np.lexsort((shingles[hits], doc))
        hits, doc = hits[order], doc[order]
        chosen = hits[np.flatnonzero(np.diff(doc, prepend=-1))]
        out[:, k] = mix(shingles[chosen] ^ mix(t[chosen].astype(np.int64), 9)).view(np.int64)
    return out


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum of smaller weights over sum of larger ones; ``a`` and ``b`` are sorted and distinct."""
    _, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = np.minimum(wa[in_a], wb[in_b]).sum()
    total = wa.sum() + wb.sum() - shared
    return float(shared / total) if total else 0.0


def shingles_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document in order, how often each occurs, and where documents begin.

    A text with fewer words than a shingle has one shingle of all its words, an empty one none.
    """
    of_word = words.hashes()
    at, found = windows(of_word, words.first, SHINGLE)
    doc = words.doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < SHINGLE))
    own = [of_word[words.first[k] : words.first[k + 1]] for k in short]
    whole = [mix((w * np.arange(3, 3 + 2 * len(w), 2, dtype=np.uint64)).sum(keepdims=True), len(w))[0] for w in own]
    keys = np.concatenate([found, np.array(whole, np.uint64)]) >> np.uint64(64 - HASH_BITS)
    keys |= np.concatenate([doc, short]).astype(np.uint64) << np.uint64(HASH_BITS)
    keys.sort()
    starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    times = np.diff(np.append(starts, len(keys)))
    docs = np.arange(len(words.first), dtype=np.uint64) << np.uint64(HASH_BITS)
    first = np.searchsorted(keys[starts], docs[:-1])
    return keys[starts] & np.uint64((1 << HASH_BITS) - 1), times, np.append(first, len(starts))


def _block_shingles(table: pa.Table):
    data, offsets = text_buffers(table["text"])
    for first, last in slices(offsets):
        bounds = offsets[first : last + 1]
        words = Words(data[bounds[0] : bounds[-1]], bounds - bounds[0])
        yield first, *shingles_of(words)


def _chosen(docs: pa.Table, wanted: pa.Table) -> pa.Table:
    """The documents of a block that are wanted, one row for each id."""
    rows = docs.filter(pc.is_in(docs["doc"], value_set=wanted["doc"].combine_chunks()))
    if len(np.unique(rows["doc"].to_numpy())) == rows.num_rows:
        return rows
    rows = rows.sort_by("digest")
    return rows.take(pa.array(np.unique(rows["doc"].to_numpy(), return_index=True)[1]))


_TYPES = {"i": pa.int32(), "l": pa.int64(), "b": pa.binary(), "d": pa.float64()}


def _table(rows: list[tuple], names: list[str], kinds: str) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table([pa.array(c, _TYPES[k]) for c, k in zip(columns, kinds)], names=names)


def _distinct(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a block and the number of its documents that have each."""
    parts = [found for _, found, _, _ in _block_shingles(table)]
    return np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)


def _ask(n_buckets: int):
    def ask(key, docs, wanted):
        hashes, counts = _distinct(_chosen(docs, wanted))
        cuts = deal(hashes, HASH_BITS, n_buckets)
        block = key[0].as_py()
        rows = [
            (block, k, int(b - a), pack(hashes[a:b]), pack_plain(counts[a:b].astype(np.int32)))
            for k, (a, b) in enumerate(zip(cuts, cuts[1:]))
            if b > a
        ]
        return _table(rows, ["block", "bucket", "n", "hashes", "counts"], "iiibb")

    return ask


def _answer(table):
    """In a bucket: the number of documents, over all blocks, that have each shingle."""
    rows = table.to_pylist()
    hashes = np.concatenate([unpack(row["hashes"], row["n"]) for row in rows])
    counts = np.concatenate([unpack_plain(row["counts"], row["n"], np.int32) for row in rows])
    every, inverse = np.unique(hashes, return_inverse=True)
    total = np.bincount(inverse, counts, len(every)).astype(np.int64)[inverse]
    out, first = [], 0
    for row in rows:
        out.append((row["block"], row["bucket"], row["n"], pack_plain(total[first : first + row["n"]])))
        first += row["n"]
    return _table(out, ["block", "bucket", "n", "counts"], "iiib")


def _rarity(hashes: np.ndarray, answers: pa.Table, n_docs: int) -> np.ndarray:
    """The weight of each of a block's distinct shingles: 1 if all documents have it, up to 1 + RARITY."""
    rows = answers.sort_by("bucket").to_pylist()
    found = [unpack_plain(row["counts"], row["n"], np.int64) for row in rows]
    frequency = np.concatenate(found) if found else np.zeros(0, np.int64)
    return 1 + RARITY * np.log(n_docs / np.maximum(frequency, 1)) / np.log(max(n_docs, 2))


def _weighed(docs: pa.Table, hashes: np.ndarray, rarity: np.ndarray):
    for start, shingles, times, first in _block_shingles(docs):
        weights = (times * rarity[np.searchsorted(hashes, shingles)]).astype(np.float32)
        full = np.flatnonzero(np.diff(first))
        yield start + full, shingles, weights, np.append(first[full], len(shingles))


def _sign(n_docs: int):
    """In a block: signatures and bands of the wanted documents that have a shingle."""

    def sign(key, docs, facts):
        docs = _chosen(docs, facts.filter(pc.is_valid(facts["doc"])))
        answers = facts.filter(pc.is_null(facts["doc"]))
        hashes, _ = _distinct(docs)
        rarity = _rarity(hashes, answers, n_docs)
        ids, found, signed, banded = docs["doc"].to_numpy(), [], [], []
        for which, shingles, weights, first in _weighed(docs, hashes, rarity):
            signature = signatures(shingles, weights, first)
            bands = np.zeros((len(which), BANDS), np.uint64)
            for k in range(SAMPLES):
                bands[:, k // ROWS] = mix(bands[:, k // ROWS] ^ signature[:, k].astype(np.uint64), k)
            found.append(ids[which])
            signed.extend(signature)
            banded.extend(bands.view(np.int64))
        lists = pa.list_(pa.int64())
        found = pa.array(np.concatenate(found) if found else [], pa.int64())
        return pa.table([found, pa.array(signed, lists), pa.array(banded, lists)], names=["doc", "signature", "bands"])

    return sign


def _weigh(n_docs: int):
    """In a block: shingles and weights of those wanted documents that are candidates."""

    def weigh(key, docs, facts):
        given = facts.filter(pc.is_valid(facts["doc"]))
        wanted = _chosen(docs, given.filter(given["candidate"]))
        out = []
        if wanted.num_rows:
            hashes, _ = _distinct(_chosen(docs, given))
            rarity = _rarity(hashes, facts.filter(pc.is_null(facts["doc"])), n_docs)
            ids = wanted["doc"].to_numpy()
            for which, shingles, weights, first in _weighed(wanted, hashes, rarity):
                for doc, a, b in zip(ids[which].tolist(), first.tolist(), first[1:].tolist()):
                    out.append((doc, b - a, pack(shingles[a:b]), weights[a:b].tobytes()))
        return _table(out, ["doc", "n", "shingles", "weights"], "libb")

    return weigh


def _verify(batches):
    """Keep the pairs whose weighted Jaccard similarity reaches the threshold."""
    for batch in batches:
        sides = []
        for side in "ab":
            n = batch[f"n_{side}"].to_pylist()
            raw, weights = batch[f"shingles_{side}"].to_pylist(), batch[f"weights_{side}"].to_pylist()
            sides.append([(unpack(r, k), np.frombuffer(w, np.float32)) for r, w, k in zip(raw, weights, n)])
        likeness = [weighted_jaccard(*a, *b) for a, b in zip(*sides)]
        keep = pa.array([value >= SIMILARITY for value in likeness])
        yield pa.RecordBatch.from_arrays(
            [batch["a"], batch["b"], pa.array(likeness, pa.float64())], names=["a", "b", "similarity"]
        ).filter(keep)


def _compare_cell(key, table):
    """Links that join the similar members of a cell: all pairs of one chunk, or of one chunk with another.

    A pair counts in the first band that it shares. Pairs are verified from the most to the least
    likely; one whose members are joined already adds nothing.
    """
    low, high = key[1].as_py(), key[2].as_py()
    nodes, chunk, band = table["node"].to_numpy(), table["chunk"].to_numpy(), table["band"][0].as_py()
    order = np.lexsort((nodes, chunk))
    n_low = int((chunk == low).sum()) if high != low else 0
    signature = np.array(table["signature"].to_pylist(), np.int64)[order]
    raw, weights, n = (table[name].to_pylist() for name in ("shingles", "weights", "n"))
    features = [(unpack(raw[i], n[i]), np.frombuffer(weights[i], np.float32)) for i in order.tolist()]
    nodes = nodes[order]
    total = np.array([own.sum() for _, own in features])
    found = []
    for i in range(n_low or len(nodes) - 1):
        first = max(n_low, i + 1)
        same = signature[first:] == signature[i]
        agreement = same.sum(axis=1)
        here = np.argmax(same.reshape(-1, BANDS, ROWS).all(axis=2), axis=1) == band
        ratio = np.minimum(total[first:], total[i]) / np.maximum(total[first:], total[i])
        hits = np.flatnonzero(here & (agreement >= LEAST_AGREEMENT) & (ratio >= SIMILARITY))
        found.append(np.stack([agreement[hits], np.full(len(hits), i), hits + first], axis=1))
    pairs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    root = list(range(len(nodes)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for _, i, j in pairs[np.argsort(-pairs[:, 0], kind="stable")].tolist():
        a, b = top(i), top(j)
        if a != b:
            likeness = weighted_jaccard(*features[i], *features[j])
            if likeness >= SIMILARITY:
                root[max(a, b)] = min(a, b)
                links.append((int(min(nodes[i], nodes[j])), int(max(nodes[i], nodes[j])), likeness))
    return _table(links, ["a", "b", "similarity"], "lld")


def cell_links(members: DataFrame, signed: DataFrame, weighed: DataFrame) -> DataFrame:
    """Links of ``members`` (bucket, band, node, size) of large buckets, as :func:`near_links` finds them."""
    chunks = F.ceil(F.col("size") / CHUNK)
    rows = members.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (chunks - 1).cast("int"))))
    rows = rows.select(
        "bucket", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "band", "node"
    )
    rows = rows.join(signed.select(F.col("doc").alias("node"), "signature"), "node")
    rows = rows.join(weighed.withColumnRenamed("doc", "node"), "node")
    return rows.groupBy("bucket", "low", "high").applyInArrow(_compare_cell, "a long, b long, similarity double")


def classes(state: DataFrame, links: DataFrame) -> DataFrame:
    """The smallest class reachable over ``links`` (a, b) from each node of ``state`` (node, class).

    Classes are named by nodes of theirs, so links between classes are links between nodes. Each round
    gives every node the smallest class among its own and its neighbours', and then the class of that
    class, so that members follow their class and long chains take few rounds.
    """
    ends = links.select("a", "b")
    for side in "ab":
        ends = ends.join(state.select(F.col("node").alias(side), F.col("class").alias(f"class_{side}")), side)
    ends = ends.filter("class_a != class_b").select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    both = store(ends.unionAll(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "class-links")
    while True:
        seen = both.join(state.select(F.col("node").alias("b"), F.col("class").alias("near")), "b")
        best = seen.groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        new = state.join(best, "node", "left").withColumnRenamed("class", "old")
        new = new.select("node", "old", F.least("old", "near").alias("class"))
        up = state.select(F.col("node").alias("class"), F.col("class").alias("higher"))
        new = new.join(up, "class", "left")
        new = store(new.select("node", "old", F.least("class", "higher").alias("class")), "classes")
        state = new.select("node", "class")
        if not new.filter("class < old").limit(1).count():
            return state


def verified_links(pairs: DataFrame, signed: DataFrame, weighed: DataFrame) -> DataFrame:
    """Of pairs (a, b) those that are similar: by signature first, then by their shingles."""
    short = signed.select("doc", "signature")
    for side in "ab":
        pairs = pairs.join(short.select(F.col("doc").alias(side), F.col("signature").alias(f"signature_{side}")), side)
    same = F.zip_with("signature_a", "signature_b", lambda x, y: F.when(x == y, 1).otherwise(0))
    agreement = F.aggregate(same, F.lit(0), lambda x, y: x + y)
    close = store(pairs.filter(agreement >= LEAST_AGREEMENT).select("a", "b"), "close-pairs")
    for side in "ab":
        full = [F.col(name).alias(f"{name}_{side}") for name in ("n", "shingles", "weights")]
        close = close.join(weighed.select(F.col("doc").alias(side), *full), side)
    return close.mapInArrow(_verify, "a long, b long, similarity double")


def near_links(
    members: DataFrame, state: DataFrame, links: DataFrame, signed: DataFrame, weighed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, similarity), enough to join all similar documents that share a ``bucket``, and the
    ``class`` of every ``node``; ``links`` and their classes (``state``) are known before.

    ``members`` has a row for each ``bucket`` and ``node`` of buckets with two nodes or more.
    """
    waiting = in_mixed_buckets(store(members.join(state, "node"), "waiting"))
    hubs_at_once = FIRST_HUBS
    while waiting.limit(1).count():
        smallest = Window.partitionBy("bucket").orderBy("node")
        hubs = waiting.withColumn("place", F.row_number().over(smallest)).filter(F.col("place") <= hubs_at_once)
        hubs = store(hubs.select("bucket", F.col("node").alias("hub"), F.col("class").alias("hub_class")), "hubs")
        pairs = waiting.join(hubs, "bucket").filter("hub_class != class")
        pairs = pairs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
        new = store(verified_links(pairs, signed, weighed), "similar")
        links = links.unionAll(new)
        # Hubs have met all that wait in their buckets. A bucket stays while the rest has two classes.
        met = hubs.select("bucket", F.col("hub").alias("node"))
        rest = waiting.drop("class").join(met, ["bucket", "node"], "left_anti")
        state = classes(state, new)
        rest = store(rest.join(state, "node"), "waiting")
        waiting = in_mixed_buckets(rest)
        hubs_at_once *= MORE_HUBS
    return links, state


def in_mixed_buckets(rows: DataFrame) -> DataFrame:
    """The rows of buckets whose members are not all of one class."""
    mixed = rows.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    return rows.join(mixed.filter("low < high").select("bucket"), "bucket", "left_semi")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``same_text`` (smallest id with an equal text) and ``class_id`` for every document id.

    Documents are linked if the weighted Jaccard similarity of their shingles is 0.8 or more; a class
    is what links join, and is named by its smallest id. Null texts count as empty; all empty texts
    are equal. Texts without a word that are not equal are not similar. Rows that share an id are one
    document, whose text is that with the smallest digest. Rows without an id are not in the result.
    Ids that are no integers are numbered in their own order first. An empty table gives no rows. Columns
    other than ``doc_id`` and ``text`` are not read.
    """
    prepare(docs.sparkSession)
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return _by_number(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc"), text.alias("text"))
    n_bytes = text_bytes(docs)
    n_blocks, n_buckets = pieces(n_bytes, BLOCK_BYTES, 4), pieces(n_bytes, BUCKET_BYTES, 4)
    digest = F.unhex(F.md5("text"))
    table = blocked(docs, ["doc", "text", digest.alias("digest")], scattered("doc", n_blocks), n_blocks)
    one_text = table.groupBy("doc").agg(F.min("digest").alias("digest"))
    by_text = one_text.groupBy("digest").agg(F.min("doc").alias("same_text"))
    named = store(one_text.join(by_text, "digest").select("doc", "same_text"), "same-text")
    chosen = named.filter("doc = same_text").select(scattered("doc", n_blocks).alias("block"), "doc")
    n_docs = chosen.count()

    by_block = table.groupBy("block")
    asked = by_block.cogroup(chosen.groupBy("block")).applyInArrow(_ask(n_buckets), _ASK)
    answers = store(asked.groupBy("bucket").applyInArrow(_answer, _ANSWER), "frequencies")

    def facts(wanted: DataFrame) -> DataFrame:
        return answers.unionByName(wanted, allowMissingColumns=True)

    signed = by_block.cogroup(facts(chosen).groupBy("block")).applyInArrow(_sign(n_docs), _SIGNED)
    signed = store(signed, "signatures")
    members = signed.select(F.col("doc").alias("node"), F.posexplode("bands").alias("band", "value"))
    members = members.select("node", "band", F.xxhash64("band", "value").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = store(members.join(shared, "bucket").select("bucket", "band", "node", "size"), "bands")
    candidates = members.select(F.col("node").alias("doc")).distinct().withColumn("candidate", F.lit(True))
    wanted = chosen.join(candidates, "doc", "left").withColumn("candidate", F.coalesce("candidate", F.lit(False)))
    weighed = by_block.cogroup(facts(wanted).groupBy("block")).applyInArrow(_weigh(n_docs), _WEIGHED)
    weighed = store(weighed, "weights")
    links = store(cell_links(members.filter(F.col("size") > LARGE_BUCKET), signed, weighed), "similar")
    state = store(members.select("node").distinct().withColumn("class", F.col("node")), "classes")
    state = classes(state, links)
    rest = members.filter(F.col("size") <= LARGE_BUCKET).select("bucket", "node")
    _, found = near_links(rest, state, links, signed, weighed)
    found = named.join(found.withColumnRenamed("node", "same_text"), "same_text", "left")
    return found.select(F.col("doc").alias("doc_id"), "same_text", F.coalesce("class", "same_text").alias("class_id"))


def _by_number(docs: DataFrame) -> DataFrame:
    """The near duplicates of documents whose ids are of any type that has an order."""
    ids = docs.filter("doc_id is not null").select(F.lit("").alias("tree"), "doc_id").distinct()
    numbers = store(ranked(ids, ["doc_id"]).select("doc_id", F.col("rank").alias("number")), "numbers")
    texts = docs.select("doc_id", "text").join(numbers, "doc_id").select(F.col("number").alias("doc_id"), "text")
    found = near_duplicates(texts)
    for name in ("doc_id", "same_text", "class_id"):
        named = numbers.select(F.col("number").alias(name), F.col("doc_id").alias("named"))
        found = found.join(named, name).drop(name).withColumnRenamed("named", name)
    return found.select("doc_id", "same_text", "class_id")
