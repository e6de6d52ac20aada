import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from brute import ROWS
from podlens.llm.merkle import build, descend, digest, fold, manifest, prove, ranked, tree_name, verified_rows


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes, fanout=2):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def beside(tree, at, fanout=2):
    """Siblings left and right of the way up from leaf ``at``."""
    steps = []
    for level in tree[:-1]:
        first = at - at % fanout
        steps.append(("".join(level[first:at]), "".join(level[at + 1 : first + fanout])))
        at //= fanout
    return steps


def brute(rows):
    """For rows of doc_id, source, lang, n_chars and text."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0], H(*map(field, row)), row))
    subroots, built = [], []
    for lang in sorted(trees, key=lambda x: (x is not None, (x or "").encode())):
        leaves = sorted(trees[lang], key=lambda x: (x[0], x[1] or 0, x[2]))
        tree = levels([known for *_, known, _ in leaves])
        built.append((leaves, tree))
        subroots.append(tree[-1][0])
    top = levels(subroots) if subroots else []
    for nth, (leaves, tree) in enumerate(built):
        for at, (_, doc_id, known, row) in enumerate(leaves):
            path = beside(tree, at) + beside(top, nth)
            n = row[3]
            if doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
                n += 1
            acc = H(*map(field, (*row[:3], n, row[4])))
            for left, right in path:
                acc = H(left, acc, right)
            proof = H(*[left + right for left, right in path])
            yield doc_id, known, tree[-1][0], top[-1][0], proof, acc, acc == top[-1][0]


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found(df):
    return sorted((tuple(row) for row in verified_rows(df).select(*COLUMNS).collect()), key=repr)


def test_odd_rows(odd, empty):
    rows = [(row[0], row[3], row[2], None if row[1] is None else len(row[1]), row[1]) for row in ROWS]
    assert found(odd) == sorted(brute(rows), key=repr)
    assert found(empty) == []


def test_equals_brute_force(docs):
    rows = [tuple(row) for row in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    whole = found(docs)
    assert whole == sorted(brute(rows), key=repr)
    assert {row[6] for row in whole} == {True, False}


def test_one_row(odd):
    rows = found(odd.filter("doc_id = 3"))
    assert len(rows) == 1 and rows[0][1] == rows[0][2] == rows[0][3] and rows[0][4] == H()


@pytest.mark.parametrize("n, fanout, depth", [(1, 2, 2), (2, 2, 2), (4, 2, 2), (5, 2, 2), (64, 2, 2), (65, 2, 3), (100, 3, 2), (31, 5, 1)])
def test_several_pages(spark, n, fanout, depth):
    """Trees of different heights, and requests for some leaves only."""
    rows = [(f"{t}", i, H(str(t), str(i))) for t, size in enumerate((n, 1, 2 * n + 1)) for i in range(size)]
    frame = spark.createDataFrame(rows, "tree string, at long, digest string").repartition(4)
    known = manifest(frame, ["at"], fanout, depth)
    trees = [levels([r[2] for r in rows if r[0] == str(t)], fanout) for t in range(3)]
    top = levels([tree[-1][0] for tree in trees], fanout)
    asked = known.leaves.filter("rank % 3 != 1").select("tree", "rank")
    asked = asked.unionAll(asked)
    got = prove(known, asked).collect()
    assert {(r["tree"], r["rank"]) for r in got} == {(r[0], r[1]) for r in rows if r[1] % 3 != 1} and len(got) * 2 == asked.count()
    for row in got:
        tree = trees[int(row["tree"])]
        steps = beside(tree, row["rank"], fanout) + beside(top, int(row["tree"]), fanout)
        assert row["digest"] == tree[0][row["rank"]] and row["subroot"] == tree[-1][0] and row["root"] == top[-1][0]
        assert [tuple(step) for step in row["path"]] == steps
    folded = prove(known, asked).select((fold(F.col("digest"), F.col("path")) == F.col("root")).alias("same"))
    assert {row["same"] for row in folded.collect()} == {True}


def test_any_change_of_a_field_is_seen(odd):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    one = odd.filter("doc_id = 4")
    known = one.select(digest([F.col(f) for f in fields])).first()[0]
    shifted = one.select(digest([F.concat("doc_id", F.lit("")), F.concat("source", "lang"), F.lit(""), F.col("n_chars"), F.col("text")]))
    assert known != shifted.first()[0]
    assert [r[0] for r in odd.select(tree_name(F.col("lang"))).distinct().orderBy(F.col("coalesce(concat(+, CAST(lang AS STRING)), )")).collect()][0] == ""
