"""Each stage of the pipeline on its own input, and the whole against the stages by hand."""

import re

import pytest
from tests.llm.tables import DOCUMENTS, odd_rows, plain_text, with_clashes
from tests.llm.test_methods import _components

import corpus_pipeline
from twinfold.llm import secret_scan

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A table folder with a small benchmark and labels."""
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(0, plain_text(2)), (1, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    marks = [(i, 1, int(i % 4 == 0)) for i in range(400)]
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_names_and_order():
    assert list(STAGES) == ["toxicity", "near_duplicates", "decontamination", "secret_scan", "mixing"]


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_columns_stay(spark, folder, name):
    given = with_clashes(spark.createDataFrame(odd_rows(), DOCUMENTS))
    out = STAGES[name](spark, given, folder)
    assert out.columns == given.columns and out.schema == given.schema
    rows = out.collect()
    assert {r["score"] for r in rows} == {"x-score"}
    empty = STAGES[name](spark, spark.createDataFrame([], DOCUMENTS), folder)
    assert empty.collect() == [] and empty.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity(spark, folder):
    texts = [plain_text(i) + (" vilegrub" if i % 4 == 0 else "") for i in range(400)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    kept = {r["doc_id"] for r in STAGES["toxicity"](spark, spark.createDataFrame(rows, DOCUMENTS), folder).collect()}
    assert kept == {i for i in range(400) if i % 4}


def test_near_duplicates(spark, folder):
    texts = [plain_text(i % 7, 80) + f" tail{i % 3}" for i in range(30)] + ["", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    kept = sorted(r["doc_id"] for r in STAGES["near_duplicates"](spark, spark.createDataFrame(rows + rows[:2], DOCUMENTS), folder).collect())
    roots, _ = _components(texts, corpus_pipeline.SHINGLE, corpus_pipeline.SIMILARITY)
    assert kept == [i for i, r in enumerate(roots) if i == r]


def test_no_text_goes_without_a_copy_that_stays(spark, folder):
    a, b, c = plain_text(1, 80), plain_text(2, 80), plain_text(3, 80)
    rows = [(1, a), (2, a + " more"), (2, b), (3, b + " more"), (None, c), (None, c + " more"), (None, c), (4, a), (5, None), (5, ""), (None, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENTS)
    kept = [(r["doc_id"], r["text"]) for r in STAGES["near_duplicates"](spark, frame, folder).collect()]
    named = [k for k in kept if k[0] is not None]
    assert sorted(named, key=str) == sorted([(1, a), (2, b), (5, None), (5, "")], key=str)
    unnamed = [k for k in kept if k[0] is None]
    assert len(unnamed) == 2 and (None, None) in unnamed and {t for _, t in unnamed if t} <= {c, c + " more"}


@pytest.mark.parametrize("doc_id", [None, 7])
def test_many_rows_with_one_id(spark, folder, doc_id):
    from twinfold.llm import near_dup

    texts = [plain_text(5, 200) + f" tail{i}" for i in range(300)] + [plain_text(6, 200)] * 300
    frame = spark.createDataFrame([(doc_id, t, "en", "s", 0) for t in texts], DOCUMENTS)
    _, classes, _ = near_dup.similar_classes(frame, 5, 80)
    sets = near_dup._sets_of(classes.select("node"), classes, frame, 5)
    assert sets.select("node").distinct().count() == classes.count() == 301
    assert sets.count() <= len(texts)  # a text meets its own class, not those of all rows with its id
    assert STAGES["near_duplicates"](spark, frame, folder).count() == 2


def test_decontamination(spark, folder):
    rows = [(i, plain_text(i) + " and " + (plain_text(2) if i == 5 else ""), "en", "s", 1) for i in range(8)]
    kept = {r["doc_id"] for r in STAGES["decontamination"](spark, spark.createDataFrame(rows, DOCUMENTS), folder).collect()}
    assert kept == {0, 1, 3, 4, 6, 7}


def test_secrets(spark, folder):
    texts = ["key AKIA" + "Q" * 16 + " ok", plain_text(1), None, "token: abcdefgh"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in STAGES["secret_scan"](spark, spark.createDataFrame(rows, DOCUMENTS), folder).collect()}
    assert got == {0: ("key [SECRET] ok", 15), 1: (texts[1], len(texts[1])), 2: (None, 0), 3: ("[SECRET]", 8)}


def test_mixing(spark, folder):
    given = with_clashes(spark.createDataFrame(odd_rows(), DOCUMENTS))
    rows = STAGES["mixing"](spark, given, folder).collect()
    assert len({(r["doc_id"], r["text"]) for r in rows}) == len(rows)
    assert all(r["copies"] > 0 for r in rows)
    assert STAGES["mixing"](spark, spark.createDataFrame([], DOCUMENTS), folder).collect() == []


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} <= set(given) and len({r["doc_id"] for r in rows}) == len(rows)
    for r in rows:
        assert r["text"] == given[r["doc_id"]] or "[SECRET]" in r["text"]
        for rule in secret_scan.RULES[:2]:
            regex = rule.regex.replace("(?i:", "(?ai:")
            assert not any(len(m.group(rule.measured)) >= rule.least for m in re.finditer(regex, r["text"]))
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) and r["taken"] == r["size"] * r["copies"]
