import hashlib
import math
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from brute import ROWS, SF
from oracle import connect, differences
from podlens.llm import queries
from podlens.llm.fingerprints import edited_fingerprints, fingerprints
from podlens.llm.license_scan import KNOWN_LICENSES, known_licenses, license_texts, scan_licenses
from podlens.llm.lm_scoring import score_texts
from podlens.llm.mixing import balance, mix, source_targets
from podlens.llm.near_dedup import near_duplicates
from podlens.llm.oracles import ORACLES
from podlens.llm.packing import pack, packed_pieces
from podlens.llm.quality_rules import judge
from podlens.llm.sharding import shard_documents
from podlens.llm.site_quality import classify
from podlens.llm.substring_dedup import indexed_matches, remove_repeats

ODD_IDS = sorted((row[0] for row in ROWS), key=lambda i: (i is None, i))


def ids(rows):
    return sorted((row["doc_id"] for row in rows), key=lambda i: (i is None, i))


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(spark, name):
    assert differences(spark, name, SF, connect(SF)) == []


# --- packing


def check_packing(rows, texts_of):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    expected = Counter(
        (doc_id, tuple(tokenizer.encode(text or "", add_special_tokens=False).ids) + (1,)) for doc_id, text in texts_of
    )
    by_sequence = defaultdict(list)
    for row in rows:
        by_sequence[row["sequence_id"]].append(row)
    ends = set()
    for number, own in by_sequence.items():
        at = 0
        for row in sorted(own, key=lambda r: r["offset"]):
            assert row["offset"] == at
            at += row["length"]
        assert at == 2048 or number == max(by_sequence)
        ends.add(number)
    assert ends == set(range(len(by_sequence)))
    return expected


def test_pack_is_exact(docs, texts):
    rows = packed_pieces(docs, queries.tokenizer_path()).collect()
    expected = check_packing(rows, texts.items())
    for doc_id, tokens in expected:
        own = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["start"])
        raw = np.array(tokens, "<u4").tobytes()
        at = 0
        for row in own:
            assert row["start"] == at and row["doc_tokens"] == len(tokens)
            assert row["ids_crc32"] == zlib.crc32(raw[4 * at : 4 * (at + row["length"])])
            at += row["length"]
        assert at == len(tokens)


def test_pack_odd_rows(odd, empty):
    rows = pack(odd, queries.tokenizer_path()).collect()
    expected = check_packing(rows, [(row[0], row[1]) for row in ROWS])
    assert sum(row["length"] for row in rows) == sum(len(t) * n for (_, t), n in expected.items())
    assert pack(empty, queries.tokenizer_path()).count() == 0


# --- fingerprints


def test_edited_fingerprints(docs, texts):
    rows = {row["doc_id"]: row for row in edited_fingerprints(docs).collect()}
    order = sorted(texts)
    near, apart = [], []
    for doc_id, following in zip(order, [*order[1:], order[0]]):
        text = texts[doc_id]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + texts[following][:cut]
        row = rows[doc_id]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        near.append(row["near_edited"])
        apart.append(row["near_next"])
    assert len(rows) == len(texts)
    assert np.mean(near) > 0.5 > 0.1 > np.mean(apart)
    by_text = defaultdict(set)
    for doc_id, row in rows.items():
        by_text[texts[doc_id]].add(row["fingerprint"])
    assert all(len(found) == 1 for found in by_text.values())


def test_fingerprints_odd_rows(odd, empty):
    rows = edited_fingerprints(odd).collect()
    assert ids(rows) == ODD_IDS
    assert all(row["fingerprint"] and 0 <= row["near_edited"] <= 1 for row in rows)
    places = fingerprints(odd).collect()
    assert ids(places) == ODD_IDS
    assert all(len(row["hashes"]) == len(row["positions"]) >= 1 for row in places)
    assert edited_fingerprints(empty).count() == 0


# --- classifier


def test_classifier_separates(spark):
    sf = "/root/testdata/sf0.01"
    rows = {row["doc_id"]: row["kept"] for row in queries.op3_site_quality(spark, sf).collect()}
    assert len(rows) == 1000
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [rows[r["doc_id"]] for r in labels if r["quality"] == 1 and r["toxic"] == 0]
    bad = [rows[r["doc_id"]] for r in labels if r["quality"] == 0 or r["toxic"] == 1]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.5


def test_sparse_sites_shrink_to_the_whole(spark):
    rng = np.random.default_rng(0)

    def text(mark):
        return " ".join(f"{''.join(rng.choice(list('abcdefgh'), 5))}{mark}" for _ in range(12))

    rows = [(i, text("$$$" if i % 2 else ""), "en", "bad") for i in range(200)]
    rows += [(1000 + i, text(""), "en", "good") for i in range(400)] + [(5000, text(""), "en", "new")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    low = F.col("text").contains("$")
    labels = frame.select("doc_id", F.when(low, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    found = classify(frame, labels, F.col("source"), F.col("lang"), ("doc_id", "source"))
    site = {row["carried_source"]: row["low_site"] for row in found.collect()}
    assert site["good"] < site["new"] < site["bad"]


def test_classifier_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, None, None), (None, 0, 1), (99, 0, 1)], "doc_id long, quality int, toxic int"
    )
    rows = classify(odd, labels, F.col("source"), F.col("lang")).collect()
    assert sorted((r["carried_doc_id"] for r in rows), key=lambda i: (i is None, i)) == ODD_IDS
    none = classify(odd, labels.limit(0), F.col("source"), F.col("lang")).collect()
    assert all(row["kept"] for row in none)
    assert classify(empty, labels, F.col("source"), F.col("lang")).count() == 0


# --- sharding


def check_shards(rows, n_rows):
    assert len(rows) == n_rows
    slots = defaultdict(list)
    for row in rows:
        assert 0 <= row["shard"] < 8
        slots[row["shard"]].append(row["slot"])
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())


def test_shards(docs, texts):
    rows = shard_documents(docs).collect()
    check_shards(rows, len(texts))
    load, shards = Counter(), defaultdict(set)
    for row in rows:
        raw = texts[row["doc_id"]].encode()
        assert row["size"] == len(raw) + 1 and row["text_crc32"] == zlib.crc32(raw)
        load[row["shard"]] += row["size"]
        shards[raw].add(row["shard"])
    largest = max(row["size"] for row in rows)
    assert max(load.values()) - min(load.values()) <= largest
    assert sum(len(own) > 1 for own in shards.values()) == 0


def test_a_group_beyond_one_shard_spreads(spark):
    rows = [(i, "same text for a third of all rows" if i % 3 == 0 else f"text number {i:09d} with a length") for i in range(3000)]
    found = shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(found, 3000)
    load, group = Counter(), Counter()
    for row in found:
        load[row["shard"]] += row["size"]
        group[row["shard"]] += row["doc_id"] % 3 == 0
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 8
    assert sum(n > 0 for n in group.values()) <= 4


def test_shards_odd_rows(odd, empty):
    rows = shard_documents(odd).collect()
    check_shards(rows, len(ROWS))
    assert ids(rows) == ODD_IDS
    assert shard_documents(empty).count() == 0


# --- substring dedup


def test_repeats_odd_rows(spark, odd, empty):
    rows = remove_repeats(odd, carry=("source", "block")).collect()
    assert ids(rows) == ODD_IDS
    named = [(row[0], row[1]) for row in ROWS if row[0] is not None]
    expected = sorted((doc_id, " ".join(kept)) for (doc_id, _), kept in zip(named, brute.repeats(named)))
    assert sorted((row["doc_id"], row["kept"]) for row in rows if row["doc_id"] is not None) == expected
    alone = [row for row in rows if row["doc_id"] is None]
    assert [row["n_removed"] for row in alone] == [0, 0]
    assert {row["carried_block"] for row in rows} == {"x"}
    assert remove_repeats(empty).count() == 0


def test_crowded_routes_are_split(spark):
    """Windows around one frequent phrase all share a route; split into single windows they still meet."""
    rng = np.random.default_rng(0)
    phrase = "a b c d e f g h".split()
    rows = []
    for i in range(60):
        left, right = rng.integers(0, 6, 8), rng.integers(0, 6, 8)
        rows.append((i, " ".join([*(f"l{x}" for x in left), *phrase, *(f"r{x}" for x in right)])))
    rows += [(100 + i, text) for i, text in rows[:30]]
    whole = [np.array([hash(w) & (2**63 - 1) for w in text.split()], np.uint64).tobytes() for _, text in rows]
    stretches = spark.createDataFrame(
        [(0, 7, doc_id, bytearray(raw)) for (doc_id, _), raw in zip(rows, whole)],
        "block int, route long, first_doc long, words binary",
    )

    def result(limit):
        out = {}
        for row in indexed_matches(stretches, route_limit=limit).collect():
            out.update(zip(np.frombuffer(row["hashes"], np.uint64).tolist(), np.frombuffer(row["docs"], np.int64).tolist()))
        return out

    assert result(10) == result(10_000)
    assert len(result(10)) > 100


def test_repeats_on_crowded_routes_are_removed(spark):
    """A phrase in many surroundings crowds its route; longer repeats across it still go."""
    rng = np.random.default_rng(2)
    phrase = "a b c d e f g h".split()
    rows = []
    for i in range(40):
        left, right = rng.integers(0, 6, 9), rng.integers(0, 6, 9)
        rows.append((i, " ".join([*(f"l{x}" for x in left), *phrase, *(f"r{x}" for x in right)])))
    rows += [(100 + i, f"own{i} {text} end{i}") for i, text in rows[:30]]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {doc_id: kept for (doc_id, _), kept in zip(rows, brute.repeats(rows))}
    assert sum(map(len, expected.values())) < sum(len(brute.words(text)) for _, text in rows) - 500
    for limit in (1, 10_000):
        found = remove_repeats(frame, route_limit=limit).collect()
        assert {row["doc_id"]: brute.words(row["kept"]) for row in found} == expected


# --- language model


def log_kt(zeros, ones):
    p = 0.0
    for k in range(zeros):
        p += math.log((k + 0.5) / (k + 1))
    for k in range(ones):
        p += math.log((k + 0.5) / (zeros + k + 1))
    return p


def brute_ctw(training, text, depth):
    """Log10 probability of the text's bytes, by recursion over context trees kept as plain dicts."""

    def bits(stream):
        for i, byte in enumerate(stream):
            context = bytes(stream[i - k] if i >= k else 10 for k in range(1, depth + 1))
            for k in range(8):
                yield context, (1 << k) | byte >> (8 - k), byte >> (7 - k) & 1

    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    for stream in training:
        for context, prefix, bit in bits(stream):
            for d in range(depth + 1):
                counts[context[:d], prefix][bit] += 1
                if d < depth:
                    children[context[:d], prefix].add(context[: d + 1])
    weighted = {}

    def weigh(context, prefix):
        if (context, prefix) not in weighted:
            own = log_kt(*counts[context, prefix])
            if len(context) < depth:
                below = sum(weigh(child, prefix) for child in children[context, prefix])
                own = np.logaddexp(own, below) - math.log(2)
            weighted[context, prefix] = own
        return weighted[context, prefix]

    total = 0.0
    for context, prefix, bit in bits(text):
        p = None
        for d in range(depth, -1, -1):
            zeros, ones = counts[context[:d], prefix]
            own = ((ones if bit else zeros) + 0.5) / (zeros + ones + 1)
            if p is None:
                p = own
            else:
                share = math.exp(log_kt(zeros, ones) - math.log(2) - weigh(context[:d], prefix))
                p = share * own + (1 - share) * p
        total += math.log10(p)
    return total


def test_scores_equal_plain_context_trees(spark):
    from podlens.llm import lm_scoring

    rows = [(i, text) for i, text in enumerate(["The cat sat", "the  hat\n", "", None, "A cat that sat there", "zebra hats"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in score_texts(frame, F.col("doc_id") >= 4).collect()}
    streams = [(" ".join(brute.words(brute.lowered(text))) + "\n").encode() for _, text in rows]
    for doc_id, _ in rows:
        assert found[doc_id]["score"] == pytest.approx(brute_ctw(streams[:4], streams[doc_id], lm_scoring.DEPTH), rel=1e-5)


def test_crowded_contexts_are_dealt_again(spark, monkeypatch):
    """No part of a frequent pair holds more than its share, and the scores stay those of plain trees."""
    from podlens.llm import lm_scoring

    sizes = []
    gathered = lm_scoring.UpperLevels

    def levels(rows):
        sizes.append(sum(row["depth"] == 2 for row in rows))
        return gathered(rows)

    monkeypatch.setattr(lm_scoring, "UpperLevels", levels)
    monkeypatch.setattr(lm_scoring, "BUCKET_KEYS", 20)
    rows = [(i, text) for i, text in enumerate(["The cat sat", "the  hat\n", "then the heath", None, "A cat that sat there"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in score_texts(frame, F.col("doc_id") >= 4).collect()}
    streams = [(" ".join(brute.words(brute.lowered(text))) + "\n").encode() for _, text in rows]
    for doc_id, _ in rows:
        assert found[doc_id]["score"] == pytest.approx(brute_ctw(streams[:4], streams[doc_id], lm_scoring.DEPTH), rel=1e-5)
    assert sizes[0] > 0
    keys = np.sort(np.arange(60000, dtype=np.uint64) * np.uint64(7919) % np.uint64(2**20) << np.uint64(30))
    parts = dict(lm_scoring._parts(keys, 5))
    assert sorted(np.concatenate(list(parts.values()))) == list(range(60000))
    assert max(map(len, parts.values())) < 20000


def test_scores(spark, texts):
    rows = {row["doc_id"]: row for row in queries.op6_context_tree_weighting(spark, SF).collect()}
    held_out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    tokens = {i: [*brute.words(brute.lowered(text)), "\n"] for i, text in texts.items()}
    counts = Counter(t for i, own in tokens.items() if not held_out[i] for t in own)
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for i, row in rows.items():
        assert row["held_out"] == held_out[i] and row["train_tokens"] == n and row["n_tokens"] == len(tokens[i])
        assert row["n_known"] == sum(counts[t] > 0 for t in tokens[i])
        expected = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens[i])
        assert row["base_score"] == pytest.approx(expected, rel=1e-9)
        assert row["score"] < 0


def test_scores_odd_rows(odd, empty):
    rows = score_texts(odd, F.col("doc_id") == 4).collect()
    assert ids(rows) == ODD_IDS
    assert all(math.isfinite(row["score"]) for row in rows)
    assert score_texts(empty, F.lit(False)).count() == 0
    untrained = score_texts(odd, F.lit(True)).collect()
    assert all(row["train_tokens"] == 0 and math.isfinite(row["score"]) for row in untrained)


# --- near duplicates


def test_near_duplicates(docs, texts):
    rows = {row["doc_id"]: row for row in near_duplicates(docs).collect()}
    assert rows.keys() == texts.keys()
    own = {i: brute.shingles(text) for i, text in texts.items()}
    for a in texts:
        for b in texts:
            if a < b:
                together = rows[a]["class_id"] == rows[b]["class_id"]
                if texts[a] == texts[b]:
                    assert together and rows[a]["same_text"] == rows[b]["same_text"]
                    continue
                shared = sum((own[a] & own[b]).values())
                total = sum((own[a] | own[b]).values())
                if total and shared / total > 0.86:
                    assert together
    linked = defaultdict(list)
    for i, row in rows.items():
        linked[row["class_id"]].append(i)
    for name, members in linked.items():
        assert name == min(members)
        for i in members[1:]:
            best = max(sum((own[i] & own[j]).values()) / max(sum((own[i] | own[j]).values()), 1) for j in members if j != i)
            assert best > 0.74 or any(texts[i] == texts[j] for j in members if j != i)


def test_chains_of_copies_are_one_class(spark):
    """Neighbours are similar, the ends are not: the class still holds all, though no hub is like all."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([f"x{i}-{k}" for k in range(0)] + base[4 * i : 4 * i + 100])) for i in range(20)]
    rows += [(100 + i, f"nothing like the others {i} " + " ".join(f"z{i}{k}" for k in range(50))) for i in range(20)]
    found = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {found[i] for i in range(20)} == {0}
    assert all(found[100 + i] == 100 + i for i in range(20))


def test_near_duplicates_odd_rows(odd, empty):
    rows = near_duplicates(odd).collect()
    assert ids(rows) == sorted({i for i in ODD_IDS if i is not None})
    found = {row["doc_id"]: row["class_id"] for row in rows}
    assert found[0] == found[1] == 0 and found[4] == found[5] == 4 and found[8] == found[9] == 8
    assert found[2] == 2 and found[3] == 3
    assert near_duplicates(empty).count() == 0


# --- licences


def test_equivalent_licence_texts(spark):
    mit = KNOWN_LICENSES["MIT"]
    rows = [
        (1, mit),
        (2, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace(",", " ;")),
        (3, mit.replace("sublicense", "sub license")),
        (4, mit + " And more."),
        (5, "Some text.\nlicensed under the apache LICENCE version 2.0\nmore"),
    ]
    found = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), known_licenses(spark))
    found = {row["doc_id"]: row for row in found.collect()}
    assert [found[i]["license_id"] for i in range(1, 6)] == ["MIT", "MIT", "MIT", None, None]
    assert found[5]["line_licenses"] == ["Apache-2.0-notice"]


def test_licence_files_as_they_come(spark):
    """Texts wrapped anywhere, with titles and copyright lines, and cut before the appendix."""
    texts = dict(license_texts()[::-1]) | {name: KNOWN_LICENSES[name] for name in ("MIT", "ISC")}
    heads = {
        "MIT": ["MIT License", "The MIT License (MIT)"],
        "ISC": ["ISC License", "ISC License (ISC)"],
        "BSD-3-Clause": ["BSD 3-Clause License"],
    }
    rows, expected = [], []
    for name, text in texts.items():
        blocks = [" ".join(block.split()) for block in re.split(r"\n\s*\n", text)]
        for width in (60, 79):
            wrapped = "\n\n".join(textwrap.fill(block, width) for block in blocks) if name in heads else text
            for head in heads.get(name, [""]):
                rows.append(f"{head}\n\nCopyright (c) 2004-2010 by Some One\nCopyright Some One 2020\n\n{wrapped}")
                expected.append(name)
    isc = KNOWN_LICENSES["ISC"].replace("above copyright", "above\ncopyright")
    rows += [isc, texts["Apache-2.0"].split("END OF TERMS")[0], texts["MIT"] + " And more.", "MIT License"]
    expected += ["ISC", "Apache-2.0", None, None]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = {row["doc_id"]: row["license_id"] for row in scan_licenses(frame, known_licenses(spark)).collect()}
    assert [found[i] for i in range(len(rows))] == expected
    assert {"Apache-2.0", "BSD-2-Clause", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0"} < set(expected)


def test_licences_odd_rows(spark, odd, empty):
    rows = scan_licenses(odd, known_licenses(spark).withColumn("digest", F.lit(1))).collect()
    assert ids(rows) == ODD_IDS
    assert all(row["license_id"] is None and row["line_licenses"] == [] for row in rows)
    assert scan_licenses(empty, known_licenses(spark)).count() == 0
    assert scan_licenses(odd, known_licenses(spark).limit(0)).count() == len(ROWS)


# --- mixing


def test_mix(docs, texts):
    sources = {row["doc_id"]: row["source"] for row in docs.collect()}
    rows = {row["doc_id"]: row for row in mix(docs).collect()}
    sizes = Counter()
    for i, text in texts.items():
        assert rows[i]["size"] == len(brute.words(text))
        sizes[sources[i]] += len(brute.words(text))
    names = sorted(sizes)
    weights = [(5, 2, 1)[k % 3] for k in range(len(names))]
    targets = brute.fill_level([sizes[s] for s in names], weights, 1.5 * sum(sizes.values()), 2)
    for name, target in zip(names, targets):
        own = [row for i, row in rows.items() if sources[i] == name]
        assert own[0]["target"] == pytest.approx(target)
        gap = abs(sum(row["taken"] for row in own) - target)
        assert gap <= max(row["size"] for row in own) / 2 + 1
        assert all(0 <= row["copies"] <= 2 for row in own)
    again = {row["doc_id"]: row["taken"] for row in mix(docs.repartition(5)).collect()}
    assert again == {i: row["taken"] for i, row in rows.items()}


def test_newton_meets_several_families(spark):
    cells = spark.createDataFrame(
        [("a", "x", 100), ("a", "y", 300), ("b", "x", 200), ("b", "y", 50)], "source string, lang string, size long"
    )
    wanted = [("source", "a", 300.0), ("source", "b", 300.0), ("lang", "x", 350.0), ("lang", "y", 250.0)]
    targets = spark.createDataFrame(wanted, 'family string, "group" string, target double'.replace('"', "`"))
    found = {(r["family"], r["group"]): r["multiplier"] for r in balance(cells, targets, ["source", "lang"], 24).collect()}
    mass = Counter()
    for row in cells.collect():
        value = row["size"] * math.exp(found["source", row["source"]] + found["lang", row["lang"]])
        mass["source", row["source"]] += value
        mass["lang", row["lang"]] += value
    for family, group, target in wanted:
        assert mass[family, group] == pytest.approx(target, rel=1e-3)


def test_targets_with_limits(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 0), (None, 500)]
    found = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    expected = brute.fill_level([10, 1000, 0, 500], [5, 2, 1, 5], 1.5 * 1510, 2)
    assert [found[s] for s, _ in sizes] == pytest.approx(expected)


def test_mix_odd_rows(odd, empty):
    rows = mix(odd).collect()
    assert ids(rows) == ODD_IDS
    assert all(row["taken"] <= 2 * row["size"] for row in rows)
    assert mix(empty).count() == 0


# --- quality rules


def test_rules(docs, texts):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = {row["doc_id"]: row for row in judge(docs).collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        assert tuple(rows[i][name] for name in names) == brute.rules(text)
        assert not (rows[i]["base_failed"] and rows[i]["kept"])


def test_rules_reject_what_is_far(spark):
    sf = "/root/testdata/sf0.01"
    rows = {row["doc_id"]: row["kept"] for row in queries.op10_divergence_rules(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    long = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(brute.words(r["text"])) >= 20}
    good = [rows[r["doc_id"]] for r in labels if r["quality"] == 1 and r["doc_id"] in long]
    bad = [rows[r["doc_id"]] for r in labels if r["quality"] == 0 and r["doc_id"] in long]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15


def test_rules_odd_rows(odd, empty):
    rows = judge(odd).collect()
    assert ids(rows) == ODD_IDS
    expected = Counter((row[0], brute.rules(row[1])[0]) for row in ROWS)
    assert Counter((row["doc_id"], row["n_words"]) for row in rows) == expected
    assert judge(empty).count() == 0


def test_large_buckets_are_compared_in_cells(spark, monkeypatch):
    """A family of copies with many edits: classes are those of all pairs that are similar."""
    from podlens.llm import near_dedup

    monkeypatch.setattr(near_dedup, "LARGE_BUCKET", 4)
    monkeypatch.setattr(near_dedup, "CHUNK", 20)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(80):
        words = list(base)
        for at in rng.integers(0, 100, rng.integers(0, 6)):
            words[at] = f"e{i}-{at}"
        rows.append((i, " ".join(words)))
    found = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    own = [brute.shingles(text) for _, text in rows]
    root = list(range(80))
    for i in range(80):
        for j in range(i):
            likeness = sum((own[i] & own[j]).values()) / sum((own[i] | own[j]).values())
            assert abs(likeness - 0.8) < 0.02 or likeness < 0.8 or found[i] == found[j]
            if likeness >= 0.78:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert all(root[i] == root[found[i]] for i in range(80))


@pytest.mark.parametrize("window", [4, 13, 16, 20, 40])
def test_passages_of_any_width_are_removed(spark, window):
    rng = np.random.default_rng(window)

    def words(n):
        return " ".join(f"w{i}" for i in rng.integers(0, 5000, n))

    shared = [words(2 * window - 2) for _ in range(6)]
    rows = [(i, f"{words(int(rng.integers(0, 9)))} {shared[i % 6]} {words(int(rng.integers(0, 9)))}") for i in range(60)]
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window).collect()
    kept = {row["doc_id"]: row["kept"] for row in found}
    expected = {i: " ".join(words) for (i, _), words in zip(rows, brute.repeats(rows, window))}
    assert kept == expected and sum(row["n_removed"] for row in found) > 54 * window


@pytest.mark.parametrize("loose", [0, 600])
def test_no_group_that_fits_is_split(spark, loose):
    rows = [(i, f"text of the group {i % 300} " + "x" * (40 + i % 300)) for i in range(6000)]
    rows += [(10000 + i, f"a text of its own {i}") for i in range(loose)]
    found = shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    shards, sizes = defaultdict(set), Counter()
    for row in found:
        shards[row["text_crc32"]].add(row["shard"])
        sizes[row["shard"]] += row["size"]
    assert len(shards) == 300 + loose and all(len(own) == 1 for own in shards.values())
    largest = 20 * (len("text of the group 299 ") + 340)
    assert len(found) == len(rows) and max(sizes.values()) - min(sizes.values()) < largest


def test_ids_of_any_type(spark, docs, texts):
    """Texts as ids: the same classes, and successors in the order of the texts."""
    named = docs.select(F.format_string("id-%05d", "doc_id").alias("doc_id"), "text")
    number = {f"id-{i:05d}": i for i in texts}
    whole = {row["doc_id"]: (row["same_text"], row["class_id"]) for row in near_duplicates(docs).collect()}
    found = {number[r["doc_id"]]: (number[r["same_text"]], number[r["class_id"]]) for r in near_duplicates(named).collect()}
    assert found == whole
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    whole = {row["doc_id"]: [row[n] for n in names] for row in edited_fingerprints(docs).collect()}
    rows = edited_fingerprints(named.unionAll(spark.createDataFrame([(None, "x")], "doc_id string, text string")))
    last = max(whole)
    found = {number.get(row["doc_id"]): [row[n] for n in names] for row in rows.collect()}
    assert {i: row for i, row in found.items() if i not in (None, last)} == {i: row for i, row in whole.items() if i != last}
    assert found[None][0] == 1 and found[last][0] == whole[last][0]


def weighted_likeness(rows):
    """The weighted Jaccard similarity of each pair (2 i, 2 i + 1), from its definition."""
    held = [brute.shingles(text) for _, text in rows]
    seen = Counter(s for own in held for s in own)

    def weight(shingle):
        return 1 + 0.1 * math.log(len(rows) / seen[shingle]) / math.log(len(rows))

    for a, b in zip(held[::2], held[1::2]):
        low = sum(min(a[s], b[s]) * weight(s) for s in a.keys() & b.keys())
        high = sum(max(a[s], b[s]) * weight(s) for s in a.keys() | b.keys())
        yield low / high


def test_recall_by_similarity(spark):
    """Made copies with a few words replaced: all from 0.8 up are found, none below it."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(500):
        words = [f"w{x}" for x in rng.integers(0, 100_000, int(rng.integers(60, 400)))]
        copy = list(words)
        for at in rng.choice(len(words), max(1, round(len(words) * rng.uniform(0.0, 0.035))), replace=False):
            copy[at] = f"n{rng.integers(0, 100_000)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    classes = {r["doc_id"]: r["class_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    by_band, wrong = defaultdict(list), 0
    for i, similarity in enumerate(weighted_likeness(rows)):
        joined = classes[2 * i] == classes[2 * i + 1]
        if similarity >= 0.8:
            by_band[int(similarity * 20)].append(joined)
        else:
            wrong += joined
    assert wrong == 0 and len(by_band[16]) > 50 and all(np.mean(found) >= 0.99 for found in by_band.values())


def test_fingerprint_likeness_and_guarantee(docs, texts):
    """Against plain Python: likeness of the selected hashes, and a shared hash for every long shared passage."""
    gram, window = 8, 16
    known = {row["doc_id"]: (row["hashes"], row["positions"]) for row in fingerprints(docs).collect()}
    order = sorted(texts)
    rows = {row["doc_id"]: row for row in edited_fingerprints(docs).collect()}

    def jaccard(a, b):
        return len(a & b) / len(a | b)

    def parts(text):
        return {int(text[i : i + 8], 16) for i in range(0, len(text), 8)}

    for doc_id, following in zip(order, [*order[1:], order[0]]):
        row = rows[doc_id]
        assert parts(row["fingerprint"]) == set(known[doc_id][0])
        assert row["near_next"] == pytest.approx(jaccard(set(known[doc_id][0]), set(known[following][0])))
        assert row["near_edited"] == pytest.approx(jaccard(parts(row["fingerprint"]), parts(row["edited_fingerprint"])))
    # Any passage of gram + window - 1 characters that two texts share gives them a hash in common.
    long = [i for i in order if len(texts[i]) > 400][:40]
    for a in long:
        passage = texts[a][100 : 100 + gram + window - 1]
        for b in order:
            if passage in texts[b]:
                at = texts[b].index(passage)
                inside = {h for h, p in zip(*known[b]) if at <= p <= at + window - 1}
                assert inside & set(known[a][0])


def test_groups_propagate_from_drawn_labels(spark):
    """With room in every shard a group gathers where most of its documents began, not where a row for it is filled in."""
    rows = [(i, f"text of the group {i % 40}") for i in range(400)]
    rows += [(10000 + i, f"a text of its own {i} " + "x" * 60) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    group = F.md5(F.encode("text", "utf-8"))
    draw = F.xxhash64(F.lit("draw"), "doc_id", group)
    began = docs.where("doc_id < 400").select("text", F.pmod(F.xxhash64(F.lit("start"), draw), F.lit(8)).alias("start"))
    votes = defaultdict(Counter)
    for row in began.collect():
        votes[zlib.crc32(row["text"].encode())][row["start"]] += 1
    assert all(len(own) > 1 for own in votes.values())
    found = defaultdict(set)
    for row in shard_documents(docs).collect():
        found[row["text_crc32"]].add(row["shard"])
    for text, own in votes.items():
        (shard,) = found[text]
        assert own[shard] == max(own.values())
