"""Packing, fill-in-the-middle and centroid clustering against brute force and exact round trips."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.tables import DOCUMENTS, odd_rows, with_clashes
from twinfold.llm import centroids, fill_middle, packing

VECTORS = "vec_id bigint, embedding array<float>, label int"


@pytest.fixture(scope="module")
def encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def _ids(encoder, text):
    return encoder.encode(text or "", add_special_tokens=False).ids + [packing.END]


# packing


def test_binary_lengths():
    assert packing.binary_lengths(1) == [1]
    assert packing.binary_lengths(2048) == [2048]
    assert packing.binary_lengths(5000) == [2048, 2048, 512, 256, 128, 8]
    for n in range(1, 300):
        cut = packing.binary_lengths(n, 32)
        assert sum(cut) == n and all(c & (c - 1) == 0 for c in cut) and cut == sorted(cut, reverse=True)
        assert len(set(c for c in cut if c < 32)) == len([c for c in cut if c < 32])


@pytest.mark.parametrize("special", [True, False])
def test_word_by_word_is_the_whole_text(encoder, monkeypatch, special):
    rng = np.random.default_rng(3)
    pool = [*"ab'st \n\r\x1c\x85\xa0éÉΣς̈12!?.", *["<|endoftext|>"] * special, "<|start", "'re", "don't", "日本", "w" * 70]
    texts = ["".join(rng.choice(pool, rng.integers(0, 60))) for _ in range(1500)] + [None, "", "x" * 500, "ab  " * 400]
    monkeypatch.setattr(packing, "BATCH", 400)
    monkeypatch.setattr(packing, "CACHED_BYTES", 3_000)
    monkeypatch.setattr(packing, "GROUP", 7)
    found = {}
    for first, ids, counts in packing._encoded(packing.default_tokenizer(), pa.array(texts)):
        found |= {first + i: own.tolist() for i, own in enumerate(np.split(ids, np.cumsum(counts)[:-1]))}
    assert [found[i] for i in range(len(texts))] == [_ids(encoder, t) for t in texts]


def test_words_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_BYTES", 1_000)
    words = packing.Words(packing.default_tokenizer())
    for i in range(50):
        words.ids(pa.array([" ".join(f"w{i}x{j}" for j in range(20))]))
        assert words._known.nbytes < 1_000 + 20 * 20


def test_segments_end_at_white_space(monkeypatch):
    monkeypatch.setattr(packing, "BATCH", 10)
    text = "one two three  four\nfive sixsixsixsixsix seven"
    parts = list(packing.segments(text))
    assert "".join(parts) == text and len(parts) > 2
    assert all(p[-1:].isspace() for p in parts[:-1])


def test_every_id_lies_in_one_piece(spark, encoder, monkeypatch):
    docs = with_clashes(spark.createDataFrame(odd_rows(), DOCUMENTS))
    rows = packing.packed(docs.repartition(3), longest=64, keep=("lang", "words")).collect()
    assert {r["words"] for r in rows} == {"x-words"}
    pieces = defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["tokens"]) and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64
        assert r["offset"] == 0
        pieces[(r["doc_id"], r["doc_tokens"])].append(r)
    for doc_id, text, *_ in odd_rows():
        ids = _ids(encoder, text)
        own = sorted(pieces[(doc_id, len(ids))], key=lambda r: (r["start"], r["sequence_id"]))
        copies = sum(1 for row in odd_rows() if row[0] == doc_id and row[1] == text)
        own = own[::copies]
        assert [t for r in own for t in r["tokens"]] == ids
        assert [r["start"] for r in own] == [sum(r["length"] for r in own[:i]) for i in range(len(own))]
    numbers = sorted((r["sequence_id"], r["length"]) for r in rows)
    assert [n for n, _ in numbers] == list(range(len(rows)))
    lengths = [n for _, n in numbers]
    assert lengths == sorted(lengths)  # a bucket is one range of numbers
    assert packing.packed(spark.createDataFrame([], DOCUMENTS)).collect() == []
    with pytest.raises(ValueError):
        packing.packed(docs, longest=100)


def test_counts_too_many_to_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(odd_rows(), DOCUMENTS).repartition(4)
    usual = sorted(tuple(r) for r in packing.unsigned_crc32(packing.packed(docs)).select("doc_id", "start", "length", "ids_crc32").fillna(-1).collect())
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(packing, "BATCH", 100)
    rows = packing.unsigned_crc32(packing.packed(docs)).fillna(-1)
    assert sorted(tuple(r) for r in rows.select("doc_id", "start", "length", "ids_crc32").collect()) == usual
    assert sorted(r["sequence_id"] for r in rows.collect()) == list(range(len(usual)))


def test_checksums(spark):
    rows = [(1, [1, 2, 49407]), (2, [0]), (3, list(range(2048)))]
    frame = spark.createDataFrame(rows, "doc_id bigint, tokens array<int>")
    got = {r["doc_id"]: r["ids_crc32"] for r in packing.unsigned_crc32(frame).collect()}
    assert got == {i: zlib.crc32(b"".join(t.to_bytes(4, "little") for t in ids)) for i, ids in rows}


def test_buckets_are_folders(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words {i} " * i) for i in range(9)], "doc_id bigint, text string")
    pieces = packing.packed(docs)
    packing.write_buckets(pieces, f"{tmp_path}/buckets")
    back = spark.read.parquet(f"{tmp_path}/buckets")
    assert {r["length"] for r in back.select("length").collect()} == {r["length"] for r in pieces.collect()}
    one = spark.read.parquet(f"{tmp_path}/buckets/length=8")
    assert {len(r["tokens"]) for r in one.collect()} == {8}


# fill in the middle


def _by_hand(doc_id, text, rate=100):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted([h[0] % (len(units) + 1), h[1] % (len(units) + 1)])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, len(units), "plain", None, None, None, text)
    if h[3] % 100 < 50:
        return (doc_id, len(units), "spm", prefix, middle, suffix, f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, len(units), "psm", prefix, middle, suffix, f"<P>{prefix}<S>{suffix}<M>{middle}")


@pytest.fixture(scope="module")
def lined(spark):
    rng = np.random.default_rng(11)
    rows = [(i, "".join(rng.choice([*"ab<>PSM\n\n\r é ", " "], rng.integers(0, 40)))) for i in range(400)]
    rows += [(i, t) for i, t, *_ in odd_rows()]
    rows += [(900, "\n"), (901, "\n\n\n"), (902, "x"), (903, "a\n<S>b\n"), (904, "line\n" * 30_000), (905, "é" * 70_000 + "\n" + "y" * 9), (906, "<P"), (906, "<P\nS>\n<")]
    return rows


@pytest.mark.parametrize("rate", [100, 30])
def test_lines_by_brute_force(spark, lined, monkeypatch, rate):
    monkeypatch.setattr(fill_middle, "SLICE", 5_000)
    docs = with_clashes(spark.createDataFrame(lined, "doc_id bigint, text string"))
    got = fill_middle.examples(docs, rate=rate).select("doc_id", "n", "form", "prefix", "middle", "suffix", "output").collect()
    key = lambda row: tuple((x is not None, x) for x in row)
    assert sorted((tuple(r) for r in got), key=key) == sorted((_by_hand(i, t, rate) for i, t in lined), key=key)


def test_round_trip(spark, lined):
    docs = spark.createDataFrame(lined, "doc_id bigint, text string")
    whole = fill_middle.examples(docs, keep=("text",))
    back = whole.select("text", fill_middle.restored(whole["output"], whole["form"]).alias("back")).collect()
    assert len(back) == len(lined)
    assert all(r["back"] == (r["text"] or "") for r in back)


def test_no_lines():
    none = fill_middle.transformed(pa.array([], pa.string()), [np.array([], dtype=np.int64)] * 4)
    assert all(len(column) == 0 for column in none.values())


def test_empty_table_of_texts(spark):
    assert fill_middle.report(spark.createDataFrame([], DOCUMENTS)).collect() == []


# centroids


def _cluster_by_hand(rows, count=8, rounds=10, size=64):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centers = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:count]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for step in range(rounds + 1):
        near = [min(range(len(centers)), key=lambda k: (far(v, centers[k]), k)) for _, v in kept]
        if step < rounds:
            for k in range(len(centers)):
                own = [v for (_, v), c in zip(kept, near) if c == k]
                if own:
                    centers[k] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, c, far(v, centers[c])) for (i, v), c in zip(kept, near)]
    inertia = defaultdict(int)
    for _, c, d in found:
        inertia[c] += d
    text = lambda c: hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest()
    return [(i, c, d, inertia[c], sum(inertia.values()), text(c)) for i, c, d in found]


def _same(got, expected):
    key = lambda row: tuple((x is not None, x) for x in row)
    assert sorted((tuple(r) for r in got), key=key) == sorted(expected, key=key)


def _vectors(seed, n):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, 64))
    return [(i, [float(np.float32(x)) for x in centers[i % 5] / 8 + rng.normal(size=64) / 10]) for i in range(n)]


def test_clusters_by_brute_force(spark):
    rows = _vectors(1, 120)
    rows += [(7, rows[7][1]), (None, rows[3][1]), (None, None), (200, []), (201, [0.5] * 63), (202, [0.5] * 63 + [None]), (203, [0.5] * 63 + [float("nan")])]
    rows += [(204, [0.5] * 63 + [float("-inf")]), (205, [0.0] * 64), (206, [-0.0] * 64), (206, [0.25] * 64)] + [(300 + i, [0.125] * 64) for i in range(60)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(5)
    _same(centroids.report(with_clashes(table)).collect(), _cluster_by_hand(rows))


@pytest.mark.parametrize("n", [0, 1, 5, 9])
def test_few_vectors(spark, n):
    rows = _vectors(2, n)
    _same(centroids.report(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)).collect(), _cluster_by_hand(rows))


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(12)]  # eight starts, two places
    got = centroids.report(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)).collect()
    _same(got, _cluster_by_hand(rows))
    assert len({r["cluster"] for r in got}) == 2


def test_only_changed_components_are_multiplied():
    rng = np.random.default_rng(5)
    vectors = rng.integers(-(1 << 20), 1 << 20, (50, 64))
    old = rng.integers(-(1 << 20), 1 << 20, (3, 64))
    new = old.copy()
    new[0, 5], new[2, ::7] = 9, -4
    got = centroids.amended(vectors @ old.T, vectors, list(new - old))
    assert (got == vectors @ new.T).all()
    hollow = vectors.copy()
    hollow[:, 6] = 0  # a place where no centroid changed
    assert (centroids.amended(vectors @ old.T, hollow, list(new - old)) == got).all()


def test_too_large_for_exact_distances(spark):
    for x in (1e6, -1e6, 3e38):
        with pytest.raises(ValueError):
            centroids.report(spark.createDataFrame([(1, [x] * 64, 0)], VECTORS))
    at_the_edge = [(1, [65535.0] * 64), (2, [-65535.0] * 64), (3, [65535.0] * 32 + [-65535.0] * 32)]
    _same(centroids.report(spark.createDataFrame([(i, v, 0) for i, v in at_the_edge], VECTORS), count=2).collect(), _cluster_by_hand(at_the_edge, 2))


def test_products_stay_exact(spark):
    rows = _vectors(4, 80)
    state, centers = centroids.clustered(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS), count=4, rounds=3)
    for r in state.collect():
        assert r["products"] == (np.array(r["v"], dtype=np.int64) @ centers.T).tolist()
