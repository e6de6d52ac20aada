"""Op 5: removal of passages that already occur in a document with a smaller id.

1. A text that equals that of a smaller document id loses all its windows, so only the others take
   part. Blocks of these ask, by hash, which of their windows of words occur in more than one
   document. That only leaves out windows that occur once.
2. Stretches of the other windows go to shards by their smallest inner n-gram, so that equal windows
   meet in one shard. Equal stretches are sent once, with the smallest document id.
3. Each shard builds a compressed FM-index of its stretches. Backward search streams the stretches
   through it; where a match reaches the threshold, the smallest document id among the matching
   suffixes is reported.
4. The reported windows go back to the blocks that hold them, where words are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podlens.llm.arrow_text import Words, covered, slices, text_buffers, windows
from podlens.llm.blobs import deal, pack, unpack
from podlens.llm.fm_index import FMIndex
from podlens.llm.tables import blocked, pieces, prepare, scattered, store, text_bytes
from podlens.session import small_side

WINDOW, GRAM = 13, 8
HASH_BITS = 48
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
SHARD_STRETCHES = 30_000
# A route with more stretches than this is split into single windows, which are unique, and asked for so.
ROUTE_STRETCHES = 10_000

_ASK = "block int, bucket int, n int, hashes binary, repeated binary"
_ANSWER = "block int, bucket int, n int, repeated binary"
_STRETCH = "block int, route long, first_doc long, words binary"
_FOUND = "stretch binary, n int, hashes binary, docs binary"


def _named(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Document ids, and which of them are given."""
    return column.fill_null(0).to_numpy().astype(np.int64), ~column.is_null().to_numpy()


def _copies(docs: pa.Table, facts: pa.Table) -> np.ndarray:
    """Which documents of a block have the text of a smaller document id."""
    held = set(zip(facts["copy_id"].to_pylist(), facts["copy_digest"].to_pylist()))
    rows = zip(docs["doc_id"].to_pylist(), docs["digest"].to_pylist())
    return np.array([i is not None and (i, digest) in held for i, digest in rows], bool)


def _texts(table: pa.Table, copies: np.ndarray):
    """Words of a block, a few documents at a time: first document, words, ids, which take part."""
    data, offsets = text_buffers(table["text"])
    ids, given = _named(table["doc_id"])
    given = given & ~copies
    for first, last in slices(offsets):
        bounds = offsets[first : last + 1]
        words = Words(data[bounds[0] : bounds[-1]], bounds - bounds[0])
        yield first, words, ids[first:last], given[first:last]


def _short(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - HASH_BITS)


def _block_hashes(table: pa.Table, copies: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct short hashes of a block's windows, and which occur in two of its documents."""
    parts = []
    for _, words, ids, given in _texts(table, copies):
        at, hashes = words.windows(window)
        doc = words.doc[at]
        parts.append((_short(hashes)[given[doc]], ids[doc[given[doc]]]))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    hashes, docs = (np.concatenate(column) for column in zip(*parts))
    order = np.argsort(hashes, kind="stable")
    hashes, docs = hashes[order], docs[order]
    starts = np.flatnonzero(np.diff(hashes, prepend=np.uint64(2**64 - 1)))
    if not len(starts):
        return hashes, np.zeros(0, bool)
    return hashes[starts], np.minimum.reduceat(docs, starts) < np.maximum.reduceat(docs, starts)


def _ask(n_buckets: int, window: int):
    def ask(key, docs, facts):
        hashes, repeated = _block_hashes(docs, _copies(docs, facts), window)
        cuts = deal(hashes, HASH_BITS, n_buckets)
        rows = [
            (key[0].as_py(), k, int(b - a), pack(hashes[a:b]), np.packbits(repeated[a:b]).tobytes())
            for k, (a, b) in enumerate(zip(cuts, cuts[1:]))
            if b > a
        ]
        return _table(rows, ["block", "bucket", "n", "hashes", "repeated"], "iiibb")

    return ask


_TYPES = {"i": pa.int32(), "l": pa.int64(), "b": pa.binary()}


def _table(rows: list[tuple], names: list[str], kinds: str) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table([pa.array(c, _TYPES[k]) for c, k in zip(columns, kinds)], names=names)


def _answer(table):
    """In a bucket: which hashes more than one block, or two documents of a block, have asked about."""
    rows = table.to_pylist()
    asked = [unpack(row["hashes"], row["n"]) for row in rows]
    flags = [np.unpackbits(np.frombuffer(row["repeated"], np.uint8), count=row["n"]) for row in rows]
    every, inverse, times = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
    repeated = times > 1
    repeated |= np.bincount(inverse, np.concatenate(flags), len(every)) > 0
    hits, out, first = repeated[inverse], [], 0
    for row in rows:
        bits = np.packbits(hits[first : first + row["n"]]).tobytes()
        out.append((row["block"], row["bucket"], row["n"], bits))
        first += row["n"]
    return _table(out, ["block", "bucket", "n", "repeated"], "iiib")


def _stretches(window: int, gram: int):
    """In a block: the distinct stretches of repeated windows that share their smallest inner n-gram."""
    names = ["block", "route", "first_doc", "words"]

    def cut(key, docs, facts):
        held: dict[bytes, list[int]] = {}
        copies, answers = _copies(docs, facts), facts.filter(pc.is_valid(facts["bucket"]))
        hashes, _ = _block_hashes(docs, copies, window) if answers.num_rows else (np.zeros(0, np.uint64), None)
        rows = answers.sort_by("bucket").to_pylist()
        bits = [np.unpackbits(np.frombuffer(row["repeated"], np.uint8), count=row["n"]) for row in rows]
        wanted = hashes[np.concatenate(bits).astype(bool)] if rows and len(hashes) else hashes[:0]
        for _, words, ids, given in _texts(docs, copies) if len(wanted) else ():
            of_word = words.hashes()
            at, found = windows(of_word, words.first, window)
            short = _short(found)
            place = np.minimum(np.searchsorted(wanted, short), len(wanted) - 1)
            at = at[(wanted[place] == short) & given[words.doc[at]]]
            if not len(at):
                continue
            gram_at, gram_hash = windows(of_word, words.first, gram)
            of_start = np.zeros(len(of_word), np.uint64)
            of_start[gram_at] = gram_hash
            route = of_start[at]
            for k in range(1, window - gram + 1):
                route = np.minimum(route, of_start[at + k])
            doc = words.doc[at]
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) != 1) | (route[1:] != route[:-1]) | (doc[1:] != doc[:-1])
            begins = np.flatnonzero(new)
            ends = at[np.append(begins[1:], len(at)) - 1] + window
            docs_of, routes = ids[doc[begins]], route[begins].view(np.int64)
            for first, last, way, doc_id in zip(at[begins].tolist(), ends.tolist(), routes.tolist(), docs_of.tolist()):
                old = held.setdefault(of_word[first:last].tobytes(), [way, doc_id])
                if doc_id < old[1]:
                    old[1] = doc_id
        block = key[0].as_py()
        return _table([(block, way, doc, raw) for raw, (way, doc) in held.items()], names, "illb")

    return cut


def _search(window: int):
    """In a shard: index the stretches, stream them through the index, report matches of the full depth."""

    def search(table):
        raw = table["words"].to_pylist()
        lengths = np.array([len(words) // 8 for words in raw])
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        alphabet, symbols = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)
        text = np.zeros(int(ends[-1]) + 1, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = symbols + 1
        hashes = np.zeros(len(text), np.uint64)
        hashes[inside] = alphabet[symbols]

        index = FMIndex(text, window)
        doc_of_row = np.repeat(table["first_doc"].to_numpy(), lengths + 1)[index.order]
        smallest = np.minimum.reduceat(doc_of_row, index.blocks(window)[:-1])
        matched, rows = index.matching_statistics(text, starts, ends, window)
        hit = matched == window
        docs = np.zeros(len(text), np.int64)
        docs[hit] = smallest[index.block_of(window, rows[hit])]

        at, found = windows(hashes[inside], np.append(starts - np.arange(len(starts)), inside.sum()), window)
        full = np.zeros(len(text), np.uint64)
        full[np.flatnonzero(inside)[at]] = found
        out = []
        for words, first, last in zip(raw, starts.tolist(), ends.tolist()):
            here = np.flatnonzero(hit[first:last]) + first
            key = hashlib.md5(words).digest()
            out.append((key, len(here), full[here].tobytes(), docs[here].tobytes()))
        return _table(out, ["stretch", "n", "hashes", "docs"], "bibb")

    return search


def _remove(window: int, carry: tuple[str, ...], join_all: bool):
    """In a block: drop the words that lie in a window known from a smaller document id."""

    def remove(docs, facts):
        copies, known = _copies(docs, facts), facts.filter(pc.is_valid(facts["hashes"]))
        hashes = np.frombuffer(b"".join(known["hashes"].to_pylist()), np.uint64)
        first_docs = np.frombuffer(b"".join(known["docs"].to_pylist()), np.int64)
        order = np.argsort(hashes, kind="stable")
        hashes, first_docs = hashes[order], first_docs[order]
        n_words, n_removed, kept = [], [], []
        for start, words, ids, given in _texts(docs, copies):
            copied = copies[start : start + len(ids)] & (words.counts >= window)
            gone = np.zeros(len(words.starts), bool)
            if len(hashes):
                at, found = words.windows(window)
                place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
                doc = words.doc[at]
                earlier = (hashes[place] == found) & (first_docs[place] < ids[doc]) & given[doc]
                gone = covered(at[earlier], window, len(words.starts))
            gone |= copied[words.doc]
            raw = words.data.tobytes()
            whole = words.offsets.tolist()
            for k, (first, last) in enumerate(zip(words.first.tolist(), words.first[1:].tolist())):
                left = ~gone[first:last]
                n_words.append(last - first)
                n_removed.append(last - first - int(left.sum()))
                if n_removed[-1]:
                    some = np.flatnonzero(left) + first
                    parts = [raw[a:b] for a, b in zip(words.starts[some].tolist(), words.ends[some].tolist())]
                    kept.append(b" ".join(parts))
                else:
                    text = raw[whole[k] : whole[k + 1]]
                    kept.append(b" ".join(text.split()) if join_all else text)
        columns = [docs["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
        columns += [pa.array(kept, pa.binary()).cast(pa.string()), *[docs[f"carried_{name}"] for name in carry]]
        names = ["doc_id", "n_words", "n_removed", "kept", *[f"carried_{name}" for name in carry]]
        return pa.table(columns, names=names)

    return remove


def later_copies(table: DataFrame) -> DataFrame:
    """``block``, ``copy_id``, ``copy_digest`` of documents with the text of a smaller document id."""
    named = table.filter("doc_id is not null").select("block", F.col("doc_id").cast("long").alias("copy_id"), "digest")
    first = named.groupBy("digest").agg(F.min("copy_id").alias("first_id"))
    copies = named.join(first, "digest").filter("copy_id > first_id")
    return store(copies.select("block", "copy_id", F.col("digest").alias("copy_digest")).distinct(), "copies")


def repeated_stretches(
    table: DataFrame, copies: DataFrame, n_bytes: int, window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """``block``, ``route``, ``first_doc``, ``words``: the stretches of windows that several documents hold."""
    by_block = table.groupBy("block")
    asked = by_block.cogroup(copies.groupBy("block")).applyInArrow(_ask(pieces(n_bytes, BUCKET_BYTES, 4), window), _ASK)
    answers = asked.groupBy("bucket").applyInArrow(_answer, _ANSWER)
    facts = answers.unionByName(copies, allowMissingColumns=True)
    found = by_block.cogroup(facts.groupBy("block")).applyInArrow(_stretches(window, gram), _STRETCH)
    return store(found, "stretches")


def crowded_routes(distinct: DataFrame, route_limit: int) -> DataFrame:
    """``route``, ``crowded``: routes with more stretches than the limit, which meet window by window."""
    crowded = distinct.groupBy("route").count().filter(F.col("count") > route_limit).select("route")
    return small_side(store(crowded, "crowded-routes")).withColumn("crowded", F.lit(True))


def search_parts(stretches: DataFrame, crowded: DataFrame, window: int) -> DataFrame:
    """The stretches as they are searched: whole, or window by window (``single``) on a crowded route."""
    length = (F.octet_length("words") / 8).cast("int")
    places = F.when(F.col("crowded"), F.sequence(F.lit(0), length - window)).otherwise(F.array(F.lit(-1)))
    ways = stretches.join(crowded, "route", "left").withColumn("at", F.explode(places))
    single = F.col("at") >= 0
    part = F.when(single, F.expr(f"substring(words, at * 8 + 1, {8 * window})")).otherwise(F.col("words"))
    return ways.withColumns({"single": single, "words": part}).drop("at", "crowded")


def indexed_matches(stretches: DataFrame, window: int = WINDOW, route_limit: int = ROUTE_STRETCHES) -> DataFrame:
    """For each distinct stretch the hashes of its windows and the smallest document id that holds each.

    Stretches of crowded routes are keyed by their single windows: ask with ``search_parts``.
    """
    return _indexed(*_routed(stretches, route_limit), window)


def _routed(stretches: DataFrame, route_limit: int) -> tuple[DataFrame, DataFrame]:
    distinct = stretches.groupBy("words", "route").agg(F.min("first_doc").alias("first_doc"))
    distinct = store(distinct, "distinct-stretches")
    return distinct, crowded_routes(distinct, route_limit)


def _indexed(distinct: DataFrame, crowded: DataFrame, window: int) -> DataFrame:
    ways = search_parts(distinct, crowded, window)
    # Stretches on a crowded route meet window by window instead: the window itself is the route.
    windows_of = ways.filter("single").groupBy("words").agg(F.min("first_doc").alias("first_doc"))
    whole = ways.filter("not single").select("words", "first_doc", "route")
    routed = whole.unionAll(windows_of.select("words", "first_doc", F.xxhash64("words").alias("route")))
    shards = pieces(distinct.count(), SHARD_STRETCHES, 4)
    routed = routed.withColumn("shard", scattered("route", shards))
    return routed.groupBy("shard").applyInArrow(_search(window), _FOUND)


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    carry: tuple[str, ...] = (),
    join_all: bool = True,
    route_limit: int = ROUTE_STRETCHES,
) -> DataFrame:
    """Remove each word covered by a window of words that also starts in a document with a smaller id.

    ``docs`` has ``doc_id`` (integer) and ``text``; ``carry`` names columns to hand through, which come
    back as ``carried_<name>``. Returns ``doc_id``, ``n_words``, ``n_removed`` and ``kept``, the kept
    words joined by one space (without ``join_all`` only if words are removed: other texts come back as
    they are, null as empty). Windows are judged on the input. A null text has no words; a text
    shorter than a window loses none. Rows that share an id are one document in this: they take
    nothing from each other. A row without an id neither loses words nor takes any from others. An
    empty table gives no rows.
    """
    prepare(docs.sparkSession)
    n_bytes = text_bytes(docs)
    kinds = {name: docs.schema[name].dataType for name in carry}
    kind = docs.schema["doc_id"].dataType.simpleString()
    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest")
    columns = ["doc_id", "text", digest, *[F.col(name).alias(f"carried_{name}") for name in carry]]
    n_blocks = pieces(n_bytes, BLOCK_BYTES, 4)
    spread = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    table = blocked(docs, columns, scattered(spread, n_blocks), n_blocks)

    copies = later_copies(table)
    stretches = repeated_stretches(table, copies, n_bytes, window, min(GRAM, window))
    distinct, crowded = _routed(stretches, route_limit)
    found = _indexed(distinct, crowded, window)
    asked = search_parts(stretches, crowded, window).select("block", "words", "single")
    # Stretches of a block differ, but may share windows.
    asked = asked.filter("not single").unionAll(asked.filter("single").distinct())
    wanted = asked.select("block", F.unhex(F.md5("words")).alias("stretch"))
    known = wanted.join(found, "stretch").select("block", "hashes", "docs")
    schema = f"doc_id {kind}, n_words long, n_removed long, kept string"
    schema += "".join(f", carried_{name} {t.simpleString()}" for name, t in kinds.items())
    facts = known.unionByName(copies, allowMissingColumns=True)
    return table.groupBy("block").cogroup(facts.groupBy("block")).applyInArrow(
        _remove(window, carry, join_all), schema
    )
