import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brute import ROWS
from podlens.llm import alignment, queries
from podlens.llm.alignment import Alignment, TokenizerPair, align, aligned_groups, shared_cuts

PATHS = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
ARGS = (*PATHS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def pair():
    return TokenizerPair(*ARGS)


def brute_tokens():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATHS[0])
    whole.encode_special_tokens = True
    pieces = SentencePieceProcessor(model_file=PATHS[1])
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in visible}
    byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}

    def second(i):
        piece = pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(text):
        a = whole.encode(" " + text, add_special_tokens=False).ids
        b = pieces.encode(text)
        a_bytes = [bytes(byte[c] for c in whole.id_to_token(i)) for i in a]
        b_bytes = [second(i) for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            return []
        groups, i, j, at, goal = [], 0, 0, 0, 0
        while i < len(a):
            first_a, first_b = i, j
            at, goal, i, j = at + len(a_bytes[i]), goal + len(b_bytes[j]), i + 1, j + 1
            while at != goal:
                if at < goal:
                    at, i = at + len(a_bytes[i]), i + 1
                else:
                    goal, j = goal + len(b_bytes[j]), j + 1
            groups.append((a[first_a:i], b[first_b:j]))
        return groups

    return tokens


def brute(texts):
    tokens = brute_tokens()
    found = [tokens(text or "") for text in texts]
    held, links = Counter(), []
    for groups in found:
        own = Counter((a, b) for left, right in groups for a in left for b in right)
        held.update(own.keys())
        links.append(own)
    highest = defaultdict(int)
    for (a, _), n in held.items():
        highest[a] = max(highest[a], n)
    for groups, own in zip(found, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (
            sum(len(a) for a, _ in groups),
            sum(len(b) for _, b in groups),
            len(groups),
            sum(own.values()),
            sum(n for p, n in own.items() if held[p] == highest[p[0]]),
            sum(n * held[p] for p, n in own.items()),
            hashlib.sha256(text.encode()).hexdigest() if text else "",
        )


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def key(row):
    return repr(tuple(row))


def test_equals_brute_force(docs):
    rows = sorted(docs.select("doc_id", "text").collect())
    expected = [(row["doc_id"], *found) for row, found in zip(rows, brute([row["text"] for row in rows]))]
    found = [tuple(row[name] for name in ("doc_id", *NAMES)) for row in align(docs, *ARGS).collect()]
    assert sorted(found) == expected


def test_odd_rows(spark, odd, empty, monkeypatch):
    more = ["<|endoftext|> as text", "a▁b", "  spaces   in\trows\n\n", "中文字符 и русский текст ไทย 😀👍🏽", "\x00\x01", "=" * 3000, "x" * 20000]
    rows = [(row[0], row[1]) for row in ROWS] + [(100 + i, text) for i, text in enumerate(more)]
    expected = sorted(((i, *found) for (i, _), found in zip(rows, brute([t for _, t in rows]))), key=repr)
    frame = odd.select("doc_id", "text").unionAll(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 300)
    found = [tuple(row[name] for name in ("doc_id", *NAMES)) for row in align(frame, *ARGS).collect()]
    assert sorted(found, key=repr) == expected
    clashing = {tuple(row[name] for name in ("doc_id", *NAMES[:4])) for row in align(odd, *ARGS).collect()}
    assert clashing <= {row[:5] for row in expected}
    assert align(empty, *ARGS).count() == 0


def test_text_ids_and_groups(spark, pair):
    frame = spark.createDataFrame([("a", "an aligned text, <in> groups"), ("b", "")], "doc_id string, text string")
    rows = aligned_groups(frame, *ARGS).orderBy("group").collect()
    whole = " an aligned text, <in> groups".encode()
    assert [row["start"] for row in rows] == [0, *[row["end"] for row in rows][:-1]] and rows[-1]["end"] == len(whole)
    for row in rows:
        part = whole[row["start"] : row["end"]]
        assert row["doc_id"] == "a"
        assert b"".join(pair.a_bytes[i] for i in row["a_ids"]) == b"".join(pair.b_bytes[i] for i in row["b_ids"]) == part
    assert {row["doc_id"]: row["n_groups"] for row in align(frame, *ARGS).collect()} == {"a": len(rows), "b": 0}


@given(st.lists(st.integers(1, 60), max_size=40), st.lists(st.integers(1, 60), max_size=40))
def test_cuts_are_the_shared_ends(a, b):
    a, b = np.cumsum([*a, 1]), np.cumsum([*b, 1])
    top = max(a[-1], b[-1]) + 1
    a, b = np.append(a, top), np.append(b, top)
    assert a[shared_cuts(a, b)].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_any_text(pair, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    found = Alignment(pair, [t.encode() for t in texts])
    tokens = brute_tokens_cached()
    expected = [";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in tokens(t)) for t in texts]
    assert [raw.decode() for raw in found.written()] == expected


def test_crowded_groups_are_reduced(pair, monkeypatch):
    found = Alignment(pair, ["some words 😀 for pairs of the 中文 ids".encode(), b"", b"again some words"])
    whole = [x.tolist() for x in found.pairs()]
    monkeypatch.setattr(alignment, "PAIRS_AT_ONCE", 1)
    assert [x.tolist() for x in found.pairs()] == whole


_held = []


def brute_tokens_cached():
    if not _held:
        _held.append(brute_tokens())
    return _held[0]
