"""Op 10: quality rules, with the verdict left to the distance from what texts of a language look like.

Each document gives two histograms: classes of characters, and common words of its language. Their
Jensen-Shannon distance from the reference histograms of that language decides, once a text has enough
words. The common words of a language are those that most of its documents have, counted over all of
them. Its reference is a mean over its documents, in which each counts as much as its share of common
words: text without any word of the language does not shape what the language looks like.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podlens.llm.arrow_text import Words, cached, covered, mix, run_hashes, runs, slices, sums, text_buffers, windows
from podlens.llm.tables import prepare, store
from podlens.session import small_side

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

# Distances are judged from this many words on; a shorter text is too small a sample. A sample of n words
# strays from its source in proportion to 1 / sqrt(n), so the limits are (base, noise): base + noise / sqrt(n).
GUARD_WORDS = 20
CHAR_LIMIT, WORD_LIMIT = (0.12, 1.4), (0.2, 1.2)

# Characters beyond ASCII by their first byte: letters of two bytes, signs (U+2000 on), other scripts, the rest.
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other", "short", "signs", "long", "far")
N_ASCII, N_COMMON = 7, 20
# Words of more bytes are not counted among the common ones.
COMMON_BYTES = 16

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _class_table() -> np.ndarray:
    """The class of each byte; bytes that go on with a character have none."""
    table = np.full(256, CLASSES.index("other"))
    table[ord("a") : ord("z") + 1] = CLASSES.index("lower")
    table[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
    table[ord("0") : ord("9") + 1] = CLASSES.index("digit")
    table[[32, *range(9, 14)]] = CLASSES.index("space")
    table[list(b".,;:!?'\"-()")] = CLASSES.index("stop")
    table[list(SYMBOLS)] = CLASSES.index("symbol")
    table[128:192] = len(CLASSES)
    table[192:224] = CLASSES.index("short")
    table[224:240] = CLASSES.index("long")
    table[226] = CLASSES.index("signs")
    table[240:] = CLASSES.index("far")
    return table


def _word_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words that are short enough, and their hashes in small ASCII letters, as signed numbers."""
    lengths = words.ends - words.starts
    small = np.flatnonzero(lengths <= COMMON_BYTES)
    data = words.data
    lowered = np.where((data >= 65) & (data <= 90), data + 32, data)
    return small, run_hashes(lowered, words.starts[small], lengths[small]).view(np.int64)


def word_hashes(words: list[str]) -> np.ndarray:
    """The hashes of some words in small letters, as :func:`measure` looks for them."""
    raw = [word.encode() for word in words]
    lengths = np.array([len(word) for word in raw])
    return run_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(lengths) - lengths, lengths).view(np.int64)


def common_words(docs: DataFrame) -> DataFrame:
    """``of_language`` and ``common``: the hashes of the words that most documents of a language have.

    Every document of the language counts. Of equally common words the smaller hash comes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch["text"])
            names = batch["language"].to_pylist()
            for first, last in slices(offsets):
                bounds = offsets[first : last + 1]
                words = Words(data[bounds[0] : bounds[-1]], bounds - bounds[0])
                small, keys = _word_keys(words)
                own = sorted(set(names[first:last]))
                number = {name: i for i, name in enumerate(own)}
                language = np.array([number[name] for name in names[first:last]], np.int64)
                # One row for each word of a document, then one for each word of a language.
                doc = words.doc[small]
                order = np.lexsort((keys, doc))
                doc, keys = doc[order], keys[order]
                new = np.ones(len(keys), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
                of, keys = language[doc[new]], keys[new]
                order = np.lexsort((keys, of))
                of, keys = of[order], keys[order]
                new = np.ones(len(keys), bool)
                new[1:] = (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])
                starts = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([own[i] for i in of[starts].tolist()], pa.string()),
                        pa.array(keys[starts]),
                        pa.array(np.diff(starts, append=len(keys))),
                    ],
                    names=["of_language", "word", "n"],
                )

    rows = docs.select(_language().alias("language"), "text")
    counts = rows.mapInArrow(run, "of_language string, word long, n long")
    counts = counts.groupBy("of_language", "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("of_language").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("place", place).filter(F.col("place") <= N_COMMON)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda one: one["word"])
    return top.groupBy("of_language").agg(listed.alias("common"))


def _language() -> Column:
    return F.coalesce("lang", F.lit(""))


def _per_document(doc: np.ndarray, value: np.ndarray, n_docs: int, n_values: int) -> np.ndarray:
    return np.bincount(doc * n_values + value, minlength=n_docs * n_values).reshape(n_docs, n_values)


def measure(
    data: np.ndarray, offsets: np.ndarray, langs: list[str], tables: dict[str, np.ndarray]
) -> dict[str, np.ndarray]:
    """Counts and histograms of some texts; ``tables`` holds the hashes of the common words by language."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    begins = (data & 0xC0) != 0x80
    lengths = words.ends - words.starts
    chars_before = np.concatenate([[0], np.cumsum(begins)])
    word_chars = chars_before[words.ends] - chars_before[words.starts]

    kinds = cached("char classes", _class_table)[data]
    doc_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    classes = _per_document(doc_of_byte, kinds, n, len(CLASSES) + 1)[:, :-1]

    hashes = words.hashes()
    at, found = windows(hashes, words.first, REPEAT_WINDOW)
    _, inverse, times = np.unique(
        mix(found ^ mix(words.doc[at], 3)), return_inverse=True, return_counts=True
    )
    repeats = covered(at[times[inverse] > 1], REPEAT_WINDOW, len(hashes))

    # Lines: runs between line feeds and document bounds; a line counts if a word begins in it.
    feeds = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), len(data))
    line_ends = line_ends - (data[line_ends - 1] == 10) if len(data) else line_ends
    worded = np.searchsorted(words.starts, line_ends) > np.searchsorted(words.starts, line_starts)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    line_keys = mix(run_hashes(data, line_starts, line_ends - line_starts) ^ mix(line_doc, 3))
    _, earliest = np.unique(line_keys, return_index=True)
    later = np.ones(len(line_keys), bool)
    later[earliest] = False

    small, keys = _word_keys(words)
    common = np.zeros((n, N_COMMON + 1), np.int64)
    lang_of = np.array(langs, object)
    for lang, table in tables.items():
        order = np.argsort(table)
        own = (lang_of == lang)[words.doc[small]]
        place = order[np.minimum(np.searchsorted(table, keys[own], sorter=order), len(table) - 1)]
        hit = table[place] == keys[own]
        common += _per_document(words.doc[small][own][hit], place[hit], n, N_COMMON + 1)
    common[:, -1] = words.counts - common.sum(axis=1)

    return {
        "n_words": words.counts,
        "word_chars": sums(word_chars, words.first),
        "n_symbols": classes[:, CLASSES.index("symbol")],
        "n_dup_lines": np.bincount(line_doc[later], minlength=n),
        "n_repeat_words": sums(repeats, words.first),
        "classes": classes,
        "common": common,
    }


def measured(docs: DataFrame) -> DataFrame:
    """Counts and histograms of every whole text, by ``doc_id`` and ``language``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch["text"])
            langs = batch["language"].to_pylist()
            lists = dict(zip(langs, batch["common"]))
            tables = {lang: np.array(words.as_py(), np.int64) for lang, words in lists.items() if words.is_valid}
            for first, last in slices(offsets):
                bounds = offsets[first : last + 1]
                found = measure(data[bounds[0] : bounds[-1]], bounds - bounds[0], langs[first:last], tables)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(first, last - first),
                        batch["language"].slice(first, last - first),
                        *[pa.array(found[name].astype(np.int64)) for name in _COUNTS],
                        *[pa.array(list(found[name]), pa.list_(pa.int64())) for name in ("classes", "common")],
                    ],
                    names=["doc_id", "language", *_COUNTS, "classes", "common"],
                )

    counts = ", ".join(f"{name} long" for name in _COUNTS)
    schema = f"doc_id {kind}, language string, {counts}, classes array<long>, common array<long>"
    words = store(common_words(docs), "common-words")
    rows = docs.select("doc_id", _language().alias("language"), "text")
    rows = rows.join(small_side(words), F.col("language") == F.col("of_language"), "left")
    return rows.select("doc_id", "language", "text", "common").mapInArrow(run, schema)


def _shares(counts: str) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)
    return F.transform(counts, lambda n: F.coalesce(F.try_divide(n, total), F.lit(0.0)))


def jensen_shannon_distance(p: str, q: str) -> Column:
    """The square root of the divergence, in bits, of two arrays of shares: from 0 to 1."""

    def term(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(F.try_divide(2 * x, x + y))).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda x, y: (term(x, y) + term(y, x)) / 2)
    total = F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)
    return F.when(total.isNotNull(), F.sqrt(F.greatest(total, F.lit(0.0))))


def language_references(rows: DataFrame) -> DataFrame:
    """Mean shares by language, over all texts that are long enough and pass the base rule, by their common words."""
    good = rows.filter(~F.col("base_failed") & (F.col("n_words") >= GUARD_WORDS))
    sizes = {"classes": len(CLASSES), "common": N_COMMON + 1}
    weight = 1 - F.col("common_shares")[N_COMMON]

    def mean(share: Column) -> Column:
        return F.try_divide(F.sum(weight * share), F.sum(weight))

    means = [mean(F.col(f"{name}_shares")[i]).alias(f"{name}{i}") for name, n in sizes.items() for i in range(n)]
    found = good.groupBy("language").agg(*means)
    arrays = [F.array(*[f"{name}{i}" for i in range(n)]).alias(f"{name}_reference") for name, n in sizes.items()]
    return found.select(F.col("language").alias("of_language"), *arrays)


def judge(docs: DataFrame) -> DataFrame:
    """Counts, the base rule, both distances and ``kept`` for every document.

    ``docs`` has ``doc_id``, ``text`` and ``lang``. A null or empty text has no words and fails the
    base rule; a null language is a language of its own. A language without any text that gives a
    reference (long enough, not failed, with a common word) has null distances, which reject nothing. Texts below the guard are judged by the base
    rule alone. Rows that repeat are judged alike; an empty table gives no rows; other columns are
    not read.
    """
    prepare(docs.sparkSession)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = store(measured(docs), "measures").select(
        "doc_id",
        "language",
        *_COUNTS,
        failed.alias("base_failed"),
        _shares("classes").alias("classes_shares"),
        _shares("common").alias("common_shares"),
    )
    references = store(language_references(rows), "references")
    joined = rows.join(small_side(references), F.col("language") == F.col("of_language"), "left")
    joined = joined.withColumns(
        {
            "char_distance": jensen_shannon_distance("classes_shares", "classes_reference"),
            "word_distance": jensen_shannon_distance("common_shares", "common_reference"),
        }
    )
    noise = 1 / F.sqrt(F.greatest("n_words", F.lit(1)))
    far = F.col("char_distance") > CHAR_LIMIT[0] + CHAR_LIMIT[1] * noise
    far = far | (F.col("word_distance") > WORD_LIMIT[0] + WORD_LIMIT[1] * noise)
    rejected = F.col("base_failed") | ((F.col("n_words") >= GUARD_WORDS) & F.coalesce(far, F.lit(False)))
    return joined.select(
        "doc_id", *_COUNTS, "base_failed", (~rejected).alias("kept"), "char_distance", "word_distance"
    )
