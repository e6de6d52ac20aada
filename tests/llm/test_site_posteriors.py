import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from brute import SF
from podlens.llm.site_quality import LEAST_PRIOR, NO_DIFFERENCE, REJECT_ABOVE, classify


def strength(groups):
    """Pseudo-documents of a prior, from the values of each group and the mean of its parent."""
    n = sum(len(own) for own, _, _ in groups)
    parents = len({parent for _, _, parent in groups})
    if n <= len(groups) or len(groups) <= parents:
        return NO_DIFFERENCE
    means = [sum(own) / len(own) for own, _, _ in groups]
    within = sum((x - m) ** 2 for (own, _, _), m in zip(groups, means) for x in own) / (n - len(groups))
    between = sum(len(own) * (m - of) ** 2 for (own, of, _), m in zip(groups, means))
    variance = (between - (len(groups) - parents) * within) / max(n - sum(len(own) ** 2 for own, _, _ in groups) / n, 1e-9)
    return min(max(within / variance, LEAST_PRIOR), NO_DIFFERENCE) if variance > 0 else NO_DIFFERENCE


def logit(p):
    return math.log(p / (1 - p))


def expected(rows):
    """For (host, path, own probability) rows: the posterior of the site without the row, and the row's own."""
    by_host, by_path = defaultdict(list), defaultdict(list)
    for host, path, own in rows:
        by_host[host].append(own)
        by_path[host, path].append(own)
    mean = sum(own for *_, own in rows) / len(rows)
    of_hosts = strength([(own, mean, None) for own in by_host.values()])
    of_paths = strength([(own, sum(by_host[key[0]]) / len(by_host[key[0]]), key[0]) for key, own in by_path.items()])
    for host, path, own in rows:
        in_host = (of_hosts * mean + sum(by_host[host]) - own) / (of_hosts + len(by_host[host]) - 1)
        in_path = (of_paths * in_host + sum(by_path[host, path]) - own) / (of_paths + len(by_path[host, path]) - 1)
        site = min(max(in_path, 1e-6), 1 - 1e-6)
        yield site, 1 / (1 + math.exp(-(logit(own) + logit(site) - logit(min(max(mean, 1e-6), 1 - 1e-6)))))


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_posteriors_equal_plain_python(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = classify(docs, labels, F.col("source"), F.col("lang"), ("doc_id", "source", "lang")).collect()
    assert len(found) == docs.count()
    for name in ("low", "toxic"):
        rows = [(r["carried_source"], r["carried_lang"], r[f"{name}_evidence"]) for r in found]
        for row, (site, probability) in zip(found, expected(rows)):
            assert row[f"{name}_site"] == pytest.approx(site, rel=1e-6, abs=1e-9)
            assert row[f"{name}_probability"] == pytest.approx(probability, rel=1e-4, abs=1e-6)
    assert all(r["kept"] == (max(r["low_probability"], r["toxic_probability"]) <= REJECT_ABOVE) for r in found)
