"""TF-IDF matching against plain numpy, file by file."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from twinfold.fixed_values import ENGLISH_STOP_WORDS, TEXT_CAP_CHARS
from twinfold.functions import text as tx
from twinfold.operators import text_similarity as ts
from twinfold.operators.components import components
from twinfold.operators.registry import corpus_scan, describe_text


def _terms(text):
    return Counter(w for w in re.findall(r"\w\w+", text.lower()) if w not in set(ENGLISH_STOP_WORDS))


def _fit(texts):
    n = len(texts)
    df = Counter(t for text in texts for t in text)
    return {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}


def _cosine(x, y, idf):
    dot = sum(x[t] * y[t] * idf[t] ** 2 for t in x.keys() & y.keys())
    norm = lambda v: math.sqrt(sum((v[t] * idf[t]) ** 2 for t in v))
    return dot / (norm(x) * norm(y)) if norm(x) and norm(y) else 0.0


def _texts(seed, n, words=25, length=12):
    """Random short texts, some of them edited copies of earlier ones, some copies in other order or case."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["été", "straße", "the", "of"]
    made = []
    for _ in range(n):
        if made and rng.random() < 0.5:
            t = rng.choice(made).split()
            kind = rng.random()
            if kind < 0.5:
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            elif kind < 0.75:
                rng.shuffle(t)
            else:
                t = [w.upper() for w in t]
            made.append(" ".join(t))
        else:
            made.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, length))))
    return made


def _frame(spark, texts, ids=None):
    rows = [(i, i, t) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "id long, arrived long, extracted_text string")


@pytest.mark.parametrize("seed,threshold,sigma,block", [(1, 0.75, 0.6, 20_000), (2, 0.75, 0.75, 3), (3, 0.5, 0.3, 5), (4, 0.9, 0.1, 50)])
def test_pairs_equal_brute_force(spark, seed, threshold, sigma, block):
    texts = _texts(seed, 60)
    terms = [_terms(t) for t in texts]
    idf = _fit(terms)
    key = lambda i: tuple(sorted(terms[i].items()))
    heads = [i for i in range(60) if terms[i] and not any(key(j) == key(i) for j in range(i))]
    want = {}
    for b in heads:
        for a in heads:
            if a < b and round(_cosine(terms[a], terms[b], idf), 8) >= threshold:
                want[a, b] = round(_cosine(terms[a], terms[b], idf), 6)
    found = ts.near_dup_pairs(_frame(spark, texts), threshold, sigma=sigma, block_rows=block).collect()
    assert {(r.id_a, r.id_b): r.similarity for r in found} == pytest.approx(want, abs=2e-6)
    copies = {i: sum(key(j) == key(i) for j in range(60)) for i in heads}
    assert all((r.copies_a, r.copies_b) == (copies[r.id_a], copies[r.id_b]) for r in found)


@pytest.mark.parametrize("seed", [5, 6])
def test_best_earlier_match_equals_brute_force(spark, seed):
    texts = _texts(seed, 60)
    terms = [_terms(t) for t in texts]
    idf = _fit(terms)
    want = {}
    for b in range(60):
        scores = [(-round(_cosine(terms[a], terms[b], idf), 8), a) for a in range(b)]
        if scores and -min(scores)[0] >= 0.75:
            want[b] = (min(scores)[1], round(-min(scores)[0], 6))
    found = ts.best_earlier_match(_frame(spark, texts)).collect()
    assert {r.id: (r.match_id, round(r.score, 6)) for r in found} == want


@pytest.mark.parametrize("seed,block", [(7, 20_000), (8, 4)])
def test_best_match_equals_a_refit_per_file(spark, seed, block):
    """Each new text is fitted together with all stored texts, as if it had come alone."""
    texts = _texts(seed, 80)
    terms = [_terms(t) for t in texts]
    stored, new = range(0, 50), range(50, 80)
    want = {}
    for q in new:
        idf = _fit([terms[q], *[terms[d] for d in stored]])
        best = min((-round(_cosine(terms[q], terms[d], idf), 8), d) for d in stored)
        if -best[0] >= 0.75:
            want[q] = (best[1], round(-best[0], 6))
    found = ts.best_match(
        _frame(spark, texts[50:], list(new)), _frame(spark, texts[:50], list(stored)), block_rows=block
    ).collect()
    assert {r.id: (r.match_id, round(r.score, 6)) for r in found} == want
    assert want
    fresh = _frame(spark, texts[50:], list(new))
    old = ts.word_table(_frame(spark, texts[:50], list(stored)))
    few = ts.stored_matches(ts.word_table(fresh), ts.member_table(fresh), old, F.lit(50), few_new=True).collect()
    assert {r.id: (r.match_id, round(r.score, 6)) for r in few} == want


def _groups_by_hand(texts, threshold):
    """(group, members, links, match, similarity) of every text, from all pairs of texts."""
    terms = [_terms(t) for t in texts]
    idf, n = _fit(terms), len(texts)
    score = {(a, b): round(_cosine(terms[a], terms[b], idf), 8) for a in range(n) for b in range(n) if a != b}
    near = {a: [b for b in range(n) if a != b and score[a, b] >= threshold] for a in range(n)}
    group = list(range(n))
    for _ in range(n):
        group = [min([group[a], *(group[b] for b in near[a])]) for a in range(n)]
    best = {a: min(((-score[a, b], b) for b in near[a]), default=None) for a in range(n)}
    return {
        a: (group[a], group.count(group[a]), len(near[a]), best[a] and best[a][1], best[a] and round(-best[a][0], 6)) for a in range(n)
    }


@pytest.mark.parametrize("seed,threshold,level,block", [(11, 0.75, 0.95, 1000), (12, 0.75, 0.6, 3), (13, 0.5, 0.5, 2), (15, 0.3, 0.2, 4)])
def test_groups_equal_brute_force(spark, seed, threshold, level, block):
    texts = [*_texts(seed, 70), "the of", "!", "w1 w2 w1 w2", "w2 w1"]
    found = ts.near_dup_groups(_frame(spark, texts), threshold, level=level, block_rows=block, link_rows=block).collect()
    got = {r.id: (r.group_id, r.members, r.links, r.match_id, r.similarity) for r in found}
    assert len(found) == len(texts) and got == _groups_by_hand(texts, threshold)


@pytest.mark.parametrize("threshold,level,block", [(0.75, 0.5, 3), (0.5, 0.9, 1000), (0.75, 0.3, 4)])
def test_families_change_no_match(spark, threshold, level, block):
    texts = _texts(21, 70)
    usual = ts.best_earlier_match(_frame(spark, texts), threshold, level=1.01).collect()  # no family at all
    other = ts.best_earlier_match(_frame(spark, texts), threshold, level=level, block_rows=block, link_rows=block).collect()
    assert usual and sorted(map(tuple, usual)) == sorted(map(tuple, other))
    new, stored = _frame(spark, texts[50:], list(range(50, 70))), _frame(spark, texts[:50])
    usual = ts.best_match(new, stored, threshold, level=1.01).collect()
    assert usual and sorted(map(tuple, usual)) == sorted(map(tuple, ts.best_match(new, stored, threshold, level=level, block_rows=block, link_rows=block).collect()))


def _family(m, others):
    """``m`` texts of one template, and texts that share one rare word with it but are not like it."""
    template = " ".join(f"tpl{i}" for i in range(200))
    made = [f"{template} own{i}" for i in range(m)]
    return made + [f"tpl{i % 40} " + " ".join(f"x{i}y{k}" for k in range(12)) for i in range(others)]


def _vectors(spark, texts):
    return ts.corpus_vectors(ts.word_table(_frame(spark, texts)), F.lit(len(texts)))


def test_a_template_leaves_rows_in_proportion(spark):
    texts = _family(120, 80)
    vectors, largest = _vectors(spark, texts)
    assert ts.nearest_leaders(vectors, 0.9).count() <= len(texts)
    families = ts._families(vectors, 0.9)
    assert families.count() == 120 and families.select("family").distinct().count() == 1
    found = ts.links_within(vectors, families, 0.75, 50)
    assert found.agg(F.sum("links")).first()[0] == 120 * 119
    assert found.count() < 8 * 120  # a row for each text and unit, none for pairs
    assert 119 <= found.where("tied IS NOT NULL").count() <= 4 * 120
    groups = ts.near_dup_groups(_frame(spark, texts), level=0.9, link_rows=50).collect()
    assert {(r.group_id, r.members, r.links) for r in groups if r.id < 120} == {(0, 120, 119)}
    assert all((r.group_id, r.members, r.links, r.match_id) == (r.id, 1, 0, None) for r in groups if r.id >= 120)


def test_a_family_leaves_no_pairs_to_the_join(spark):
    """What a text has found in its family is the least that it looks for among all others."""
    texts = _family(60, 20) + ["alpha beta gamma delta eps zeta", "alpha beta gamma delta eps eta"]
    vectors, largest = _vectors(spark, texts)
    families = ts._families(vectors, 0.9)
    known = ts.best_of(ts.partners(ts.links_within(vectors, families, 0.75), "before"))
    assert known.count() == 59

    def pairs(families, known):
        asking = ts._asking(vectors, families, known, 0.75, 0.7)
        sides = ts.prefix_rows(asking.drop("bar"), "a", 0.7, extra=["family"]), ts.prefix_rows(asking, "b", 0.7, extra=["family", "need", "bar"])
        apart = (F.col("arrived_a") < F.col("arrived_b")) & (F.col("family_a") != F.col("family_b"))
        return ts.candidate_pairs(*sides, apart, 0.75, 0.7, 20_000, largest, "b").count()

    assert pairs(families, known) <= 3
    assert pairs(families.where("false"), known.where("false")) >= 60 * 59 // 2


def test_empty_corpus_and_empty_vocabulary(spark):
    one = _frame(spark, ["alpha beta gamma"])
    none = _frame(spark, ["x"]).where("false")
    assert ts.best_match(one, none).count() == 0
    assert ts.best_match(_frame(spark, ["the of a !"]), one).count() == 0
    assert ts.near_dup_pairs(_frame(spark, ["the of", "a b c", "  "])).count() == 0
    assert ts.near_dup_groups(none).count() == 0
    assert [tuple(r) for r in ts.near_dup_groups(_frame(spark, ["the of"])).collect()] == [(0, 0, 1, 0, None, None)]


def test_score_at_the_threshold_counts(spark):
    """Two texts with cosine exactly 1/2 under any weights that are equal for all terms."""
    corpus = _frame(spark, ["aa bb", "bb cc", "cc aa"])
    assert ts.near_dup_pairs(corpus, 0.5).count() == 3
    assert ts.near_dup_pairs(corpus, 0.500001).count() == 0


def test_a_flood_of_copies_gives_one_row_per_copy(spark):
    texts = ["alpha beta gamma delta"] * 200 + ["alpha beta gamma", "other words here"]
    found = {r.id: r.match_id for r in ts.best_earlier_match(_frame(spark, texts)).collect()}
    assert found == {i: 0 for i in range(1, 201)}


def test_clean_and_tokens(spark):
    def run(expression, value):
        return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).first()[0]

    for value in ["Hello, World! x_1", "Ünïcode ÉTÉ—naïve", "a\tb\nc", "don't e-mail", "日本語 テスト"]:
        assert run(tx.clean, value) == re.sub(r"[^\w\s]", " ", value.lower())
        assert run(lambda c: tx.tokens(c, []), value) == re.findall(r"\b\w\w+\b", value.lower())
    assert run(tx.extracted_text, " \n\t ") is None
    assert run(tx.extracted_text, "A\r\nB\rC") == "a\nb\nc"
    assert run(lambda c: tx.extracted_text(c, 3), "abcdef") == "abc"
    long = "word " * (TEXT_CAP_CHARS // 4)
    assert len(run(tx.extracted_text, long)) == len(long) > TEXT_CAP_CHARS


def test_decode_leaves_bad_bytes_out(spark):
    data = b"ab\xffcd \xef\xbf\xbd \xc3\xa9 \xe2\x82"
    found = spark.createDataFrame([(bytearray(data),)], "b binary").select(tx.decode_utf8(F.col("b"))).first()[0]
    assert found == data.decode("utf-8", "ignore").replace("�", " ")


def test_only_text_types_are_read(spark):
    rows = [(1, "txt", "Some Text"), (2, "mp4", "Some Text"), (3, "md", " ")]
    obs = spark.createDataFrame(rows, "id long, file_type string, content string").withColumn("download_time", F.lit(0))
    assert [r.id for r in corpus_scan(describe_text(obs)).collect()] == [1]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (7, 9), (9, 7)]
    root = {n: n for pair in links for n in pair}
    for _ in links:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {a for a, b in links if a == b and sum(a in pair for pair in links) == 1}
    assert found == {n: r for n, r in root.items() if n not in alone}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
