"""Nulls, empty and long texts, repeated rows, empty tables and extra columns, for every operator on documents."""

import pytest
from tests.llm.tables import DOCUMENTS, odd_rows, plain_text, with_clashes
from twinfold.llm import chunk_dedup, common, decontaminate, mixing, near_dup, quality_bt, quality_rules, secret_scan, toxicity

LABELS = "doc_id bigint, quality int, toxic int"


def _labels(spark, rows=None):
    if rows is None:
        rows = [(i, i % 2, (i + 1) % 2) for i in range(12)] + [(3, 1, 1), (None, 1, 1), (5, None, None), (99, 1, 0)]
    return spark.createDataFrame(rows, LABELS)


def _benchmark(spark, rows=None):
    rows = [(0, plain_text(2)), (1, None), (2, ""), (None, plain_text(4, 3)), (0, plain_text(2))] if rows is None else rows
    return spark.createDataFrame(rows, "item_id bigint, text string")


PER_DOCUMENT = {
    "quality_bt": lambda s, d: quality_bt.classify(d, _labels(s)),
    "mixing": lambda s, d: mixing.mixture(d),
    "near_dup": lambda s, d: near_dup.near_duplicates(d),
    "decontaminate": lambda s, d: decontaminate.contamination(d, _benchmark(s)),
    "secret_scan": lambda s, d: secret_scan.report(d),
    "toxicity": lambda s, d: toxicity.classify(d, _labels(s)),
    "quality_rules": lambda s, d: quality_rules.judged(d),
}


@pytest.fixture(scope="module")
def odd(spark):
    return with_clashes(spark.createDataFrame(odd_rows(), DOCUMENTS))


@pytest.mark.parametrize("name", list(PER_DOCUMENT))
def test_one_row_per_document(spark, odd, name):
    rows = PER_DOCUMENT[name](spark, odd).collect()
    key = lambda x: (x is not None, x)
    assert sorted((r["doc_id"] for r in rows), key=key) == sorted((r[0] for r in odd_rows()), key=key)
    assert [r for r in rows if r["doc_id"] == 16][0] == [r for r in rows if r["doc_id"] == 16][1]


@pytest.mark.parametrize("name", list(PER_DOCUMENT))
def test_empty_tables(spark, name):
    empty = spark.createDataFrame([], DOCUMENTS)
    assert PER_DOCUMENT[name](spark, empty).collect() == []


def test_learning_without_labels(spark, odd):
    none = _labels(spark, [])
    assert {r["score"] for r in quality_bt.classify(odd, none).collect()} == {0.5}
    assert {(r["score"], r["rejected"]) for r in toxicity.classify(odd, none).collect()} == {(0.0, False)}


def test_one_long_text_leaves_the_rest_of_the_sample(spark):
    rows = [(i, plain_text(i), "en", "s", 0) for i in range(20)]
    marks = _labels(spark, [(i, i % 2, i % 2) for i in range(24)])
    sample = lambda texts, most: common.labelled_sample(spark.createDataFrame(texts, DOCUMENTS), marks, "toxic", 100, most)
    usual = {(r["doc_id"], r["label"]) for r in sample(rows, 20_000).collect()}
    assert usual == {(i, i % 2) for i in range(20)}
    for long in ([20], [21], [20, 21, 22, 23]):  # whatever its place in the order
        texts = rows + [(i, "long " * 5_000, "en", "s", 0) for i in long]
        assert {(r["doc_id"], r["label"]) for r in sample(texts, 20_000).collect()} == usual
    some = [r for r in sample(rows + [(22, "x" * 4_000, "en", "s", 0), (23, "x" * 900, "en", "s", 0)], 5_000).collect()]
    assert sum(len(r["text"]) for r in some) <= 5_000 and {r["label"] for r in some} == {0, 1}


def test_decontamination_values(spark, odd):
    found = {r["doc_id"]: r for r in decontaminate.contamination(odd, _benchmark(spark)).collect() if r["doc_id"] is not None}
    assert found[2]["n_hit"] == found[2]["n_words"] == 60
    assert found[2]["n_items"] == 1 and found[2]["items_sha256"] == decontaminate.items_digest(["0"])
    assert found[4]["n_hit"] == 3 and found[4]["items_sha256"] == decontaminate.items_digest([""])
    for i in (12, 13, 14):
        assert (found[i]["n_words"], found[i]["contaminated"]) == (0, False)
    nothing = decontaminate.contamination(odd, _benchmark(spark, [])).collect()
    assert not any(r["contaminated"] for r in nothing)


def test_near_duplicate_values(spark, odd):
    found = {r["doc_id"]: r for r in near_dup.near_duplicates(odd).collect()}
    assert (found[16]["component_id"], found[16]["kept"]) == (3, False)
    assert (found[12]["n_shingles"], found[12]["component_id"]) == (0, 12)
    assert (found[17]["n_shingles"], found[17]["kept"]) == (1, True)
    assert found[15]["n_shingles"] > 30_000


def test_quality_rule_values(spark, odd):
    found = {r["doc_id"]: r for r in quality_rules.judged(odd).collect()}
    assert (found[13]["n_words"], found[13]["base_failed"], found[13]["kept"]) == (0, True, False)
    assert (found[1]["n_words"], found[1]["kept"]) == (60, True)
    assert found[15]["n_words"] == 60_000


def test_mixing_values(spark, odd):
    rows = mixing.mixture(odd).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (12, 13, 14)} == {0}


def test_repeated_passages(spark, odd):
    found = [tuple(r) for r in chunk_dedup.passages(odd).collect()]
    assert {(f[0], f[4]) for f in found} == {(16, 3)}  # doc 15 repeats itself, which is no repeat across documents
    assert chunk_dedup.passages(spark.createDataFrame([], DOCUMENTS)).collect() == []
