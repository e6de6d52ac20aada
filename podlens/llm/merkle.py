"""Op 12: a manifest of the rows as a content-addressed graph, with proofs by descent from the root.

Every row is a leaf, known by the digest of its fields. Leaves of a tree are ordered; runs of ``fanout``
nodes become a node whose digest is that of its children's, level by level, until one is left, and the
trees' own roots are the leaves of a last tree. What is stored are records of a digest and its children,
several levels of them to a page, so that a page has at most ``fanout ** depth`` leaves below it.

A request names a leaf by its rank. It descends from the root, a page at a time: the digits of the rank
choose a child at every node and the children not chosen are collected. Requests that still share
their way go down together, so that a page near the root is not asked once for each leaf. At the leaf the
path is turned round, and folding it over the leaf's digest gives the root again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from podlens.llm.tables import pieces, prepare, store

FANOUT, DEPTH = 2, 10
RANGE_ROWS = 500_000
ALL = "-"

_STEPS = "array<struct<before string, after string>>"
_PAGE = "tree string, page long, digest string, records array<struct<digest string, children array<string>>>"
_FOUND = f"tree string, rank long, digest string, path {_STEPS}, segment {_STEPS}"


def field(value: Column) -> Column:
    """One field of a row as it goes into a digest: ``-``, or the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(value) for value in fields]), 256)


def tree_name(value: Column) -> Column:
    """A name for each value that is never null and sorts with null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("+"), value.cast("string")), F.lit(""))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``rank`` (from 0) within each ``tree``, by ``order``, and ``size``, the tree's number of rows.

    Rows are sorted by range over all trees, so that one tree may hold them all. Equal rows are told
    apart by a number, so that many of them do not share a range.
    """
    rows = store(rows.withColumn("nth", F.monotonically_increasing_id()), "rows")
    by = ["tree", *order, "nth"]
    parts = pieces(rows.count(), RANGE_ROWS)
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    # The number within a partition is what follows the partition's own bits.
    seat = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = store(ranged.select("*", F.spark_partition_id().alias("part"), seat.alias("seat")), "ranged")
    # A row for each tree and range it reaches into.
    runs = placed.groupBy("part", "tree").agg(F.min("seat").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    ahead = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")
    runs = runs.select("part", "tree", shift.alias("shift"), F.sum("n").over(tree).alias("size"))
    found = placed.join(runs, ["part", "tree"])
    return found.select(*[name for name in rows.columns if name != "nth"], (F.col("seat") + F.col("shift")).alias("rank"), "size")


def _hashed(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _pages(nodes: DataFrame, fanout: int, depth: int) -> DataFrame:
    """Records of ``depth`` levels above the nodes (fewer where a tree ends), a row for each page."""
    width = fanout**depth

    def page(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["rank"].to_pylist(), table["digest"].to_pylist()))
        level, records = [known for _, known in rows], []
        whole = table["size"][0].as_py() > width
        for _ in range(depth):
            if len(level) == 1 and not whole:
                break
            runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
            level = [_hashed("".join(run)) for run in runs]
            records += [{"digest": known, "children": run} for known, run in zip(level, runs)]
        names = ["tree", "page", "digest", "records"]
        one = [[table["tree"][0].as_py()], [rows[0][0] // width], level, [records]]
        kinds = [pa.string(), pa.int64(), pa.string(), _RECORDS]
        return pa.table([pa.array(value, kind) for value, kind in zip(one, kinds)], names=names)

    several = nodes.filter("size > 1").withColumn("page", F.expr(f"rank div {width}"))
    return several.groupBy("tree", "page").applyInArrow(page, _PAGE)


_RECORDS = pa.list_(pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))]))


@dataclass(frozen=True)
class Forest:
    """Trees over the same kind of leaves: pages by level (0 is next to the leaves), and a root for each tree."""

    pages: list[DataFrame]
    roots: DataFrame
    fanout: int
    depth: int


def build(leaves: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> Forest:
    """Trees over ``leaves`` (``tree``, ``rank``, ``digest``, ``size``).

    Each turn of the loop has a thousandth of the nodes of the one before.
    """
    width = fanout**depth
    nodes, pages = leaves.select("tree", "rank", "digest", "size"), []
    levels = nodes.agg(F.max("size")).first()[0] or 0
    roots = nodes.filter("size = 1").select("tree", "digest", F.lit(0).alias("levels"), "size")
    sizes = nodes.groupBy("tree").agg(F.first("size").alias("leaves"))
    while levels > 1:
        found = store(_pages(nodes, fanout, depth), "pages", "zstd")
        pages.append(found)
        above = nodes.filter("rank = 0").select("tree", F.ceil(F.col("size") / width).alias("size"))
        nodes = found.join(above, "tree").select("tree", F.col("page").alias("rank"), "digest", "size")
        done = nodes.filter("size = 1").select("tree", "digest", F.lit(len(pages)).alias("levels"), "size")
        roots, levels = roots.unionAll(done), -(-levels // width)
    roots = roots.join(sizes, "tree").select("tree", "digest", "levels", "leaves")
    return Forest(pages, store(roots, "roots"), fanout, depth)


def _walk(fanout: int, depth: int):
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = fanout**depth
        for batch in batches:
            columns = [batch[name].to_pylist() for name in ("tree", "page", "digest", "records", "digits", "nodes")]
            for i, (tree, page, root, records, digits, nodes) in enumerate(zip(*columns)):
                children = {record["digest"]: record["children"] for record in records}
                levels = 0
                while levels < depth and (nodes > width or fanout**levels < nodes):
                    levels += 1
                found, ends, before, after = [], [0], [], []
                for digit in digits:
                    known = root
                    for level in range(levels - 1, -1, -1):
                        run, place = children[known], digit // fanout**level % fanout
                        before.append("".join(run[:place]))
                        after.append("".join(run[place + 1 :]))
                        known = run[place]
                    found.append(known)
                    ends.append(len(before))
                steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tree] * len(digits), pa.string()),
                        pa.array([page * width + digit for digit in digits], pa.int64()),
                        pa.array(found, pa.string()),
                        batch["path"].take(pa.array([i] * len(digits), pa.int64())),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps),
                    ],
                    names=["tree", "rank", "digest", "path", "segment"],
                )

    return walk


def descend(forest: Forest, start: DataFrame, requests: DataFrame) -> DataFrame:
    """Follow ``requests`` (``tree``, ``rank``) from the roots of their trees down to the leaves.

    ``start`` holds ``tree`` and the ``path`` that leads to its root. The result has ``tree``, ``rank``,
    the ``digest`` found there, and ``path`` from the root on: a step for each level, with the digests
    left and right of the way. Repeated requests give one row; ranks a tree does not have must not be asked.
    """
    width = forest.fanout**forest.depth
    at_root = forest.roots.join(start, "tree").select("*", F.lit(0).cast("long").alias("rank"))
    found = at_root.filter(F.col("levels") == len(forest.pages)).select("tree", "rank", "digest", "path")
    sizes = forest.roots.select("tree", "leaves")
    for level in range(len(forest.pages) - 1, -1, -1):
        below = width**level
        wanted = requests.select("tree", F.expr(f"rank div {below * width}").alias("page"), F.expr(f"rank div {below} % {width}").alias("digit"))
        wanted = wanted.groupBy("tree", "page").agg(F.sort_array(F.collect_set("digit")).alias("digits"))
        wanted = wanted.join(sizes, "tree").withColumn("nodes", F.ceil(F.col("leaves") / below))
        here = found.withColumnRenamed("rank", "page").join(wanted, ["tree", "page"])
        records = forest.pages[level].select("digest", "records").dropDuplicates(["digest"])
        walked = here.join(records, "digest").select("tree", "page", "digest", "records", "digits", "nodes", "path")
        walked = walked.mapInArrow(_walk(forest.fanout, forest.depth), _FOUND)
        found = walked.select("tree", "rank", "digest", F.concat("path", "segment").alias("path"))
        # Trees whose root lies on this level join in; trees of one leaf have no page at all.
        found = found.unionAll(at_root.filter(F.col("levels") == level).select("tree", "rank", "digest", "path"))
        if level:
            found = store(found, "descent", "zstd")
    return found


@dataclass(frozen=True)
class Manifest:
    """``leaves`` has the rows' own columns with ``tree``, ``rank`` and ``digest``; ``root`` has one row."""

    leaves: DataFrame
    trees: Forest
    subroots: DataFrame
    top: Forest


def manifest(rows: DataFrame, order: list[str], fanout: int = FANOUT, depth: int = DEPTH) -> Manifest:
    """Build the records over ``rows``, which have ``tree``, ``digest`` and other columns of their own.

    Ties of ``order`` are ordered by digest. An empty table gives a manifest without root.
    """
    prepare(rows.sparkSession)
    leaves = store(ranked(rows, [*order, "digest"]), "leaves", "zstd")
    trees = build(leaves, fanout, depth)
    named = trees.roots.select(F.lit(ALL).alias("tree"), F.col("tree").alias("name"), "digest")
    subroots = store(ranked(named, ["name"]), "subroots")
    return Manifest(leaves, trees, subroots, build(subroots, fanout, depth))


def prove(store_: Manifest, requests: DataFrame) -> DataFrame:
    """For each distinct request (``tree``, ``rank``): ``digest``, ``subroot``, ``root`` and the ``path`` to it.

    The path leads from the leaf to the root: folding ``before`` + digest + ``after`` over it gives the
    root (see ``fold``). What is read depends on the requests' pages, not on all leaves.
    """
    empty = F.array().cast(_STEPS)
    names = requests.select(F.col("tree").alias("name")).distinct()
    ranks = store_.subroots.join(names, "name", "left_semi").select("tree", "rank")
    down = descend(store_.top, store_.top.roots.select("tree", empty.alias("path")), ranks)
    root = store_.top.roots.select("tree", F.col("digest").alias("root"))
    down = down.withColumnRenamed("digest", "subroot").join(store_.subroots.drop("digest"), ["tree", "rank"])
    start = store(down.join(root, "tree").select(F.col("name").alias("tree"), "path", "subroot", "root"), "start")
    found = descend(store_.trees, start.select("tree", "path"), requests)
    found = found.join(start.select("tree", "subroot", "root"), "tree")
    return found.withColumn("path", F.reverse("path"))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path from leaf to root give."""
    return F.aggregate(path, leaf, lambda known, step: F.sha2(F.concat(step["before"], known, step["after"]), 256))


def siblings(path: Column) -> Column:
    """All digests beside the path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def verified_rows(docs: DataFrame) -> DataFrame:
    """Every document with its proof, and whether a tampered copy of some documents passes.

    ``docs`` has ``doc_id``, ``source``, ``lang``, ``n_chars`` and ``text``; other columns are not read.
    There is a tree for each language, null first; leaves ascend by ``doc_id`` (null first), rows with
    one id by digest. Where 7 divides the checksum of the id, 1 is added to ``n_chars`` in the copy; null
    stays null and such a row, like one without an id, is not tampered with. Repeated rows are leaves
    of their own with equal digests. An empty table gives no rows.
    """
    fields = [F.col(name) for name in ("doc_id", "source", "lang", "n_chars", "text")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    tampered = digest([n_chars if i == 3 else value for i, value in enumerate(fields)])
    rows = docs.select(
        tree_name(F.col("lang")).alias("tree"), "doc_id", digest(fields).alias("digest"), tampered.alias("tampered")
    )
    known = manifest(rows, ["doc_id"])
    proofs = prove(known, known.leaves.select("tree", "rank")).withColumnRenamed("digest", "leaf")
    found = known.leaves.select("tree", "rank", "doc_id", "tampered").join(proofs, ["tree", "rank"])
    found = found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        fold(F.col("tampered"), F.col("path")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
