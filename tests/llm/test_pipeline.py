from collections import Counter

import pytest

import brute
from brute import ROWS, SF
import corpus_pipeline
from podlens.llm.tables import store


@pytest.fixture(scope="module")
def stages(spark, docs):
    """The result of each stage on the result of the one before."""
    found = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = found[name] = store(stage(spark, docs, SF), f"test-{name}")
    return found


def test_stages_keep_the_columns(stages, docs):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].dtypes == docs.dtypes


def test_each_stage_does_its_part(stages):
    rows = {name: found.collect() for name, found in stages.items()}
    judged = {r["doc_id"] for r in rows["quality_classifier"]}
    assert judged <= {r["doc_id"] for r in rows["documents"]}
    one_each = rows["near_dedup"]
    assert len({r["text"] for r in one_each}) == len(one_each)
    named = [(r["doc_id"], r["text"]) for r in one_each]
    expected = {i: kept for (i, _), kept in zip(named, brute.repeats(named)) if kept}
    assert {r["doc_id"]: brute.words(r["text"]) for r in rows["substring_dedup"]} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in rows["substring_dedup"])
    times = Counter(r["doc_id"] for r in rows["mix_sources"])
    assert set(times.values()) <= {1, 2} and times.keys() <= expected.keys()
    packed = Counter()
    for piece in rows["curve_packing"]:
        packed[piece["doc_id"]] += piece["start"] == 0
    assert packed == times


def test_odd_rows_and_empty_tables(spark, odd, empty):
    for docs, n in ((odd, len(ROWS)), (empty, 0)):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = store(stage(spark, docs, SF), f"odd-{name}")
            if name != "curve_packing":
                assert docs.columns == columns
                assert docs.count() <= 2 * n
        assert (docs.count() > 0) == (n > 0)
