"""Op 3: a quality classifier that weighs a document's own evidence with that of its host and path.

1. Labelled documents give log-odds of features (words, and binned shares of characters and repeats).
   Only features that are significant and strong enough are kept.
2. Every document sums the log-odds of its features: its own evidence for low quality and for toxicity.
3. Hosts and paths get posteriors by hierarchical empirical Bayes: sums by host and path, shrunk
   towards the host, and that towards all documents, the more the fewer documents a site has. How
   strongly is estimated from how far sites differ beyond chance.
4. The posterior of the site, without the document itself, replaces the global prior in its odds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podlens.llm.arrow_text import Words, cached, mix, slices, text_buffers
from podlens.llm.quality_rules import N_ASCII, measure, word_hashes
from podlens.llm.tables import prepare, store
from podlens.session import small_side

# The classifier is fitted on at most so many labelled documents, chosen by a hash of their ids.
MAX_LABELLED = 20_000
# A feature counts if enough documents have it, and its log-odds and its likelihood ratio statistic (about the
# square of its deviations from 0) are large enough.
MIN_DOCUMENTS, MIN_LOG_ODDS, MIN_RATIO = 8, 1.0, 30.0
EDGES = np.array([0.002, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8])
LENGTHS = np.array([40])
FAMILY_WORDS = 5
TARGETS = ("low", "toxic")
MAX_LOGIT = 12.0
# A document goes only if its odds are clear: a wrong rejection weighs more than a missed one.
REJECT_ABOVE = 0.9
# Pseudo-documents of a prior: at least, and where sites do not differ beyond chance.
LEAST_PRIOR, NO_DIFFERENCE = 0.01, 1e9


# Frequent words of languages that the labels may be in.
FREQUENT_WORDS = {
    "en": "the of and to a in is that it for on was with as be by are this at from",
    "fr": "de la le et les des un en du que est une pour dans qui au par sur pas avec",
    "de": "der die und in den von zu das mit sich für des auf ist im nicht dem eine ein als",
    "es": "de la que el en y los se del las por un con para una no su es al lo",
}


def _frequent() -> dict[str, np.ndarray]:
    return {lang: word_hashes(words.split()) for lang, words in FREQUENT_WORDS.items()}


def _letters() -> np.ndarray:
    """Bytes as letters in lower case; all else as spaces."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def features(data: np.ndarray, offsets: np.ndarray, langs: list) -> tuple[Words, np.ndarray, np.ndarray]:
    """The letter words of some texts with their hashes, and a row of binned shares for each text.

    Bins differ by the length of a text, as a short one strays further. A text without words has no shares.
    """
    found = measure(data, offsets, langs, cached("frequent words", _frequent))
    n_words = found["n_words"]
    size = np.maximum(found["classes"].sum(axis=1), 1)
    # All characters beyond ASCII are one class here.
    shares = [found["classes"][:, k] / size for k in range(N_ASCII)]
    shares.append(found["classes"][:, N_ASCII:].sum(axis=1) / size)
    shares += [found["n_repeat_words"] / np.maximum(n_words, 1), found["common"][:, -1] / np.maximum(n_words, 1)]
    length = np.searchsorted(LENGTHS, n_words)
    bins = [(k * 16 + np.searchsorted(EDGES, share)) * 8 + length + 1 for k, share in enumerate(shares)]
    bins = np.stack(bins, axis=1).astype(np.uint64)
    words = Words(cached("letters", _letters)[data], offsets)
    return words, words.hashes(), bins


def _chunks(batch: pa.RecordBatch):
    data, offsets = text_buffers(batch["text"])
    langs = batch["lang"].to_pylist()
    for first, last in slices(offsets):
        bounds = offsets[first : last + 1]
        yield first, last, *features(data[bounds[0] : bounds[-1]], bounds - bounds[0], langs[first:last])


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """Documents with a label: ``text``, ``lang``, ``low``, ``toxic``; at most ``limit`` labels are used.

    A family is the documents with the same smallest hash of their shingles, as near copies mostly have.
    """
    known = labels.select(
        F.col("doc_id").alias("label_id"),
        (F.col("quality") == 0).cast("int").alias("low"),
        (F.col("toxic") == 1).cast("int").alias("toxic"),
    )
    known = known.filter("label_id is not null").orderBy(F.xxhash64("label_id"), "low", "toxic").limit(limit)
    chosen = docs.join(F.broadcast(known), F.col("doc_id") == F.col("label_id"))

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch["text"])
            found = []
            for first, last in slices(offsets):
                bounds = offsets[first : last + 1]
                words = Words(data[bounds[0] : bounds[-1]], bounds - bounds[0])
                at, hashes = words.windows(FAMILY_WORDS)
                smallest = np.full(last - first, 2**64 - 1, np.uint64)
                np.minimum.at(smallest, words.doc[at], hashes)
                found.append(smallest.view(np.int64))
            yield batch.append_column("family", pa.array(np.concatenate(found) if found else [], pa.int64()))

    columns = "text string, lang string, low int, toxic int"
    rows = chosen.select("text", "lang", "low", "toxic").mapInArrow(families, f"{columns}, family long")
    # Copies would make all their words look significant: of a family and label one text counts. Texts too
    # short to have a family are families of their own.
    short = F.col("family") == -1
    own = F.when(short, F.xxhash64("text")).otherwise(F.col("family"))
    one = F.min_by(F.struct("text", "lang"), F.xxhash64("text")).alias("one")
    rows = rows.groupBy(own.alias("family"), "low", "toxic").agg(one)
    return store(rows.select("one.text", "one.lang", "low", "toxic"), "labelled")


def feature_counts(sample: DataFrame) -> DataFrame:
    """For each feature and target the labelled documents that have it: with the target and in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            targets = [batch[name].to_numpy(zero_copy_only=False).astype(float) for name in TARGETS]
            for first, last, words, hashes, bins in _chunks(batch):
                doc = np.concatenate([words.doc, np.repeat(np.arange(last - first), bins.shape[1])])
                feature = np.concatenate([hashes, bins.ravel()])
                _, once = np.unique(mix(feature ^ mix(doc, 3)), return_index=True)
                every, inverse = np.unique(feature[once], return_inverse=True)
                columns = [pa.array(every.view(np.int64))]
                for target in targets:
                    own = target[first:last][doc[once]]
                    given = ~np.isnan(own)
                    columns.append(pa.array(np.bincount(inverse[given], own[given], len(every)).astype(np.int64)))
                    columns.append(pa.array(np.bincount(inverse[given], minlength=len(every)).astype(np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names=["feature", "low", "low_of", "toxic", "toxic_of"])

    rows = sample.mapInArrow(count, "feature long, low long, low_of long, toxic long, toxic_of long")
    return rows.groupBy("feature").agg(*[F.sum(name).alias(name) for name in ("low", "low_of", "toxic", "toxic_of")])


def _times_log(n: Column, ratio: Column) -> Column:
    return F.when(n > 0, n * F.log(ratio)).otherwise(F.lit(0.0))


class Evidence:
    """Log-odds of the chosen features, and the prior log-odds, for each target."""

    def __init__(self, counts: DataFrame, totals):
        self.prior, self.tables = {}, {}
        for name in TARGETS:
            n, of = totals[name] or 0, totals[f"{name}_of"] or 0
            self.prior[name] = float(np.log((n + 0.5) / (of - n + 0.5)))
            with_it, without = F.col(name) + 0.5, F.col(f"{name}_of") - F.col(name) + 0.5
            odds = F.log(with_it / (n + 1)) - F.log(without / (of - n + 1))
            share = (n + 0.5) / (of + 1)
            have, hits = F.col(f"{name}_of"), F.col(name)
            others = have - hits
            ratio = _times_log(hits, hits / (have * share)) + _times_log(others, others / (have * (1 - share)))
            columns = [have.alias("have"), odds.alias("odds"), (2 * ratio).alias("ratio")]
            chosen = counts.filter(have > 0).select("feature", *columns)
            chosen = chosen.filter((F.col("have") >= MIN_DOCUMENTS) & (F.abs("odds") >= MIN_LOG_ODDS))
            # Features of the labelled sample, whose size is bounded: eight of its documents have each.
            rows = chosen.filter(F.col("ratio") >= MIN_RATIO).select("feature", "odds").collect()
            table = np.array([row[0] for row in rows], np.int64).view(np.uint64)
            order = np.argsort(table)
            self.tables[name] = table[order], np.array([row[1] for row in rows], np.float64)[order]

    def logits(self, name: str, words: Words, hashes: np.ndarray, bins: np.ndarray) -> np.ndarray:
        table, odds = self.tables[name]
        n = len(bins)
        if not len(table):
            return np.full(n, self.prior[name])
        doc = np.concatenate([words.doc, np.repeat(np.arange(n), bins.shape[1])])
        feature = np.concatenate([hashes, bins.ravel()])
        place = np.minimum(np.searchsorted(table, feature), len(table) - 1)
        hit = table[place] == feature
        pairs = np.unique(doc[hit] * len(table) + place[hit])
        found = np.bincount(pairs // len(table), odds[pairs % len(table)], n)
        return np.clip(self.prior[name] + found, -MAX_LOGIT, MAX_LOGIT)


def document_evidence(docs: DataFrame, evidence: Evidence, carry: tuple[str, ...]) -> DataFrame:
    """``host``, ``path``, the carried columns, and the document's own log-odds for each target."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.drop_columns(["text", "lang"])
            for first, last, words, hashes, bins in _chunks(batch):
                logits = [pa.array(evidence.logits(name, words, hashes, bins)) for name in TARGETS]
                part = rest.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *logits], names=[*part.schema.names, *[f"{name}_logit" for name in TARGETS]]
                )

    kinds = {f"carried_{name}": docs.schema[name].dataType.simpleString() for name in carry}
    schema = ", ".join(f"{name} {kind}" for name, kind in ({"host": "string", "path": "string"} | kinds).items())
    schema += "".join(f", {name}_logit double" for name in TARGETS)
    carried = [F.col(name).alias(f"carried_{name}") for name in carry]
    return docs.select("text", "lang", "host", "path", *carried).mapInArrow(score, schema)


def _sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, name: str, n_parents: Column | int) -> float:
    """Pseudo-documents of the prior: variance within groups over variance between them beyond chance.

    ``groups`` has n, the sum s and the sum of squares q of each group, and the mean ``m`` of its parent.
    """
    row = groups.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("groups"),
        F.sum(F.col(f"{name}_q") - F.col(f"{name}_s") ** 2 / F.col("n")).alias("within"),
        F.sum(F.col("n") * (F.col(f"{name}_s") / F.col("n") - F.col(f"{name}_m")) ** 2).alias("between"),
        F.sum(F.col("n") ** 2).alias("squares"),
    ).first()
    if not row["n"] or row["n"] <= row["groups"] or row["groups"] <= n_parents:
        return NO_DIFFERENCE
    within = row["within"] / (row["n"] - row["groups"])
    spread = row["between"] - (row["groups"] - n_parents) * within
    variance = spread / max(row["n"] - row["squares"] / row["n"], 1e-9)
    return min(max(within / variance, LEAST_PRIOR), NO_DIFFERENCE) if variance > 0 else NO_DIFFERENCE


def site_posteriors(rows: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, tuple[float, float, float]]]:
    """Sums by path and by host, and for each target (global mean, strength of hosts, strength of paths)."""
    sums = [F.count("*").alias("n")]
    for name in TARGETS:
        p = _sigmoid(F.col(f"{name}_logit"))
        sums += [F.sum(p).alias(f"{name}_s"), F.sum(p * p).alias(f"{name}_q")]
    paths = store(rows.groupBy("host", "path").agg(*sums), "paths")
    totals = [F.sum(c).alias(c) for c in paths.columns if c not in ("host", "path")]
    hosts = store(paths.groupBy("host").agg(*totals), "hosts")
    n_hosts = hosts.count()
    every = hosts.agg(F.sum("n").alias("n"), *[F.sum(f"{name}_s").alias(name) for name in TARGETS]).first()
    levels = {}
    for name in TARGETS:
        mean = every[name] / every["n"] if every["n"] else 0.5
        of_hosts = _strength(hosts.withColumn(f"{name}_m", F.lit(mean)), name, 1)
        means = hosts.select(F.col("host").alias("of_host"), (F.col(f"{name}_s") / F.col("n")).alias(f"{name}_m"))
        inner = paths.join(small_side(means), F.col("host").eqNullSafe(F.col("of_host")))
        levels[name] = mean, of_hosts, _strength(inner, name, n_hosts)
    return paths, hosts, levels


def classify(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, carry: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """Probabilities of low quality and toxicity for every document, and ``kept``.

    ``docs`` has ``doc_id``, ``text`` and ``lang``; ``host`` and ``path`` say where a document comes
    from. ``labels`` has ``doc_id``, ``quality`` (0 is low) and ``toxic`` (1 is toxic); null labels
    are left out. Columns in ``carry`` come back as ``carried_<name>``. A document goes if either
    probability is above REJECT_ABOVE. A null text counts as empty; a null host or path is one of its own.
    Without labels nothing is rejected. Rows that repeat are judged alike. An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    places = {"host": host.cast("string"), "path": path.cast("string"), "lang": F.col("lang").cast("string")}
    docs = docs.withColumns(places)
    sample = labelled_sample(docs, labels)
    counts = store(feature_counts(sample), "feature-counts")
    given = [F.sum(name).alias(name) for name in TARGETS] + [F.count(name).alias(f"{name}_of") for name in TARGETS]
    evidence = Evidence(counts, sample.agg(*given).first())
    rows = store(document_evidence(docs, evidence, carry), "evidence", "zstd")
    paths, hosts, levels = site_posteriors(rows)
    hosts = hosts.select(
        F.col("host").alias("of_host"),
        F.col("n").alias("host_n"),
        *[F.col(f"{name}_s").alias(f"{name}_host") for name in TARGETS],
    )
    paths = paths.select(
        F.col("host").alias("path_host"),
        F.col("path").alias("of_path"),
        F.col("n").alias("path_n"),
        *[F.col(f"{name}_s").alias(f"{name}_path") for name in TARGETS],
    )
    sites = paths.join(small_side(hosts), F.col("path_host").eqNullSafe(F.col("of_host"))).drop("of_host")
    same = F.col("host").eqNullSafe(F.col("path_host")) & F.col("path").eqNullSafe(F.col("of_path"))
    joined = rows.join(small_side(sites), same)
    columns = [f"carried_{name}" for name in carry]
    kept = F.lit(True)
    for name in TARGETS:
        mean, of_hosts, of_paths = levels[name]
        own = _sigmoid(F.col(f"{name}_logit"))
        # The document itself is left out of its site.
        in_host = (of_hosts * mean + F.col(f"{name}_host") - own) / (of_hosts + F.col("host_n") - 1)
        in_path = (of_paths * in_host + F.col(f"{name}_path") - own) / (of_paths + F.col("path_n") - 1)
        site = F.least(F.greatest(in_path, F.lit(1e-6)), F.lit(1 - 1e-6))
        base = F.lit(min(max(mean, 1e-6), 1 - 1e-6))
        joined = joined.withColumns(
            {
                f"{name}_evidence": own,
                f"{name}_site": site,
                f"{name}_probability": _sigmoid(F.col(f"{name}_logit") + _logit(site) - _logit(base)),
            }
        )
        columns += [f"{name}_evidence", f"{name}_site", f"{name}_probability"]
        kept = kept & (F.col(f"{name}_probability") <= REJECT_ABOVE)
    return joined.select(*columns, kept.alias("kept"))
