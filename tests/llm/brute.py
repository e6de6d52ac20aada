"""Plain Python versions of what the operators compute, and rows that are hard to get right."""

import re
from collections import Counter

SF = "/root/testdata/sf0.001"

# Columns whose names the operators use for their own purposes.
CLASHING = "block bucket part row size group draw digest shard place at words source_size target n host path doc".split()

LONG = " ".join(f"word{i} of a very long text" for i in range(6000))
ROWS = [
    (0, None, None, None),
    (1, "", "en", "a"),
    (2, " \t\n ", "en", "a"),
    (3, "one", "en", None),
    (4, "the cat and the dog of the house went to the river to look for a fish in it", "en", "a"),
    (5, "the cat and the dog of the house went to the river to look for a fish in it", "en", "b"),
    (5, "the cat and the dog of the house went to the river to look for a fish in it", "en", "b"),
    (6, "So: the cat and the dog of the house went to the river to look for a fish, and more", "xx", "b"),
    (None, "a text without an id of its own that is long enough for all the windows in here", "en", "b"),
    (None, None, "en", "b"),
    (7, "É€𝄞 ünḯcödé ​\x00 text | *** ### &&&", "fr", "c"),
    (8, LONG, "en", "a"),
    (9, LONG + " end", "en", "a"),
]

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def repeats(rows, window=13):
    """For (doc_id, text) rows, with ids: kept words of each, in order of the rows."""
    first = {}
    for doc_id, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < doc_id:
                gone.update(range(i, i + window))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def rules(text):
    w = words(text)
    seen, dup_lines = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup_lines += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times, covered = Counter(grams), set()
    for i, gram in enumerate(grams):
        if times[gram] > 1:
            covered.update(range(i, i + 5))
    n = len(w)
    failed = n < 10 or 100 * len(covered) > 20 * n
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return n, sum(map(len, w)), symbols, dup_lines, len(covered), failed


def shingles(text, n=5):
    w = words(text)
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def winnow(hashes, window):
    """Positions: the rightmost smallest hash of each window."""
    if len(hashes) <= window:
        windows = [(0, len(hashes))]
    else:
        windows = [(i, i + window) for i in range(len(hashes) - window + 1)]
    return sorted({max(range(a, b), key=lambda i: (-hashes[i], i)) for a, b in windows})


def fill_level(sizes, weights, total, limit):
    """Targets by weight with limits, by sharing the excess again until none is above."""
    free = set(range(len(sizes)))
    while True:
        rest = total - sum(limit * sizes[i] for i in range(len(sizes)) if i not in free)
        level = rest / sum(weights[i] for i in free)
        over = {i for i in free if weights[i] * level > limit * sizes[i]}
        if not over:
            return [weights[i] * level if i in free else limit * sizes[i] for i in range(len(sizes))]
        free -= over
