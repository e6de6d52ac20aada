import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import brute
from podlens.llm.arrow_text import Words
from podlens.llm.quality_rules import CHAR_LIMIT, CLASSES, WORD_LIMIT, _word_keys, common_words, judge

STOP, SYMBOL = ".,;:!?'\"-()", "#*$%&|<>"


def char_class(c):
    raw = c.encode()
    if len(raw) > 1:
        return "signs" if raw[0] == 0xE2 else {2: "short", 3: "long", 4: "far"}[len(raw)]
    if "a" <= c <= "z":
        return "lower"
    if "A" <= c <= "Z":
        return "upper"
    if "0" <= c <= "9":
        return "digit"
    if c in " \t\n\v\f\r":
        return "space"
    return "stop" if c in STOP else "symbol" if c in SYMBOL else "other"


def key(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(_word_keys(Words(raw, np.array([0, len(raw)])))[1][0])


def distance(p, q):
    def term(x, y):
        return x * math.log2(2 * x / (x + y)) if x > 0 else 0.0

    return math.sqrt(max(0.0, sum((term(x, y) + term(y, x)) / 2 for x, y in zip(p, q))))


def shares(counts):
    total = sum(counts)
    return [n / total if total else 0.0 for n in counts]


def verdicts(rows):
    """For (doc_id, text, lang) rows: both distances and the verdict, from their definitions."""
    seen = defaultdict(Counter)
    for _, text, lang in rows:
        seen[lang or ""].update({brute.lowered(w) for w in brute.words(text) if len(w.encode()) <= 16})
    common = {lang: sorted(words, key=lambda w: (-words[w], key(w)))[:20] for lang, words in seen.items()}
    known = []
    for _, text, lang in rows:
        words = Counter(map(brute.lowered, brute.words(text)))
        top = [words[w] for w in common[lang or ""]]
        top = top + [0] * (20 - len(top)) + [sum(words.values()) - sum(top)]
        kinds = Counter(map(char_class, text or ""))
        n, *_, failed = brute.rules(text)
        known.append((lang or "", n, failed, shares([kinds[c] for c in CLASSES]), shares(top)))
    references = {}
    for lang in seen:
        good = [row for row in known if row[0] == lang and not row[2] and row[1] >= 20]
        weight = sum(1 - row[4][-1] for row in good)
        if good and weight:
            references[lang] = [
                [sum((1 - row[4][-1]) * row[k][i] for row in good) / weight for i in range(len(good[0][k]))] for k in (3, 4)
            ]
    for lang, n, failed, classes, top in known:
        if lang not in references:
            yield None, None, not failed
            continue
        char, word = distance(classes, references[lang][0]), distance(top, references[lang][1])
        noise = 1 / math.sqrt(max(n, 1))
        far = char > CHAR_LIMIT[0] + CHAR_LIMIT[1] * noise or word > WORD_LIMIT[0] + WORD_LIMIT[1] * noise
        yield char, word, not (failed or (n >= 20 and far))


def check(df, rows):
    found = sorted(((r.doc_id, r.char_distance, r.word_distance, r.kept) for r in judge(df).collect()), key=repr)
    expected = sorted(((row[0], *own) for row, own in zip(rows, verdicts(rows))), key=repr)
    assert len(found) == len(expected)
    for (i, char, word, kept), (j, own_char, own_word, own_kept) in zip(found, expected):
        assert (i, kept) == (j, own_kept)
        for got, want in ((char, own_char), (word, own_word)):
            assert got is None and want is None or got == pytest.approx(want, abs=1e-6)


def test_distances_and_verdicts_equal_plain_python(docs):
    check(docs, [(r.doc_id, r.text, r.lang) for r in docs.collect()])


def test_odd_rows(odd):
    rows = [(row[0], row[1], row[2]) for row in brute.ROWS if row[0] != 5]
    check(odd.filter("doc_id is null or doc_id <> 5"), [r for r in rows])


def made():
    r = random.Random(1)
    vocabulary = ["".join(r.choices("abcdefghijkl", k=6)) for _ in range(3000)]
    rows = []
    for i in range(60):
        spoken = [r.choice(["nie", "się", "na", "że", "do"]) if r.random() < 0.3 else r.choice(vocabulary) for _ in range(80)]
        noise = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(80)]
        script = [r.choice(["и", "в", "не"]) if r.random() < 0.3 else "".join(r.choices("абвгдежзик", k=6)) for _ in range(80)]
        boxes = ["".join(r.choices("─│┌┐└┘├┤┬┴┼", k=5)) for _ in range(80)]
        rows += [(4 * i, " ".join(spoken), "pl"), (4 * i + 1, " ".join(noise), "pl")]
        rows += [(4 * i + 2, " ".join(script), "ru"), (4 * i + 3, " ".join(boxes), "ru")]
    return rows


def test_junk_in_any_language_is_rejected(spark):
    """Half of the texts of two languages hold no word of them."""
    rows = made()
    kept = {r.doc_id: r.kept for r in judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(kept[i] == (i % 2 == 0) for i in kept) and len(kept) == len(rows)


def test_common_words_count_every_document(spark):
    frame = spark.createDataFrame(made(), "doc_id long, text string, lang string").repartition(7)
    found = {r.of_language: r.common for r in common_words(frame).collect()}
    assert set(found["pl"][:5]) == {key(w) for w in ("nie", "się", "na", "że", "do")}
    assert set(found["ru"][:3]) == {key(w) for w in ("и", "в", "не")}
