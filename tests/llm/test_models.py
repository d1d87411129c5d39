"""The two trained models against plain loops: forward passes, gradients, features and the optimum."""

import math
import zlib

import numpy as np
import pytest
from twinfold.llm import quality_bt, toxicity

# toxicity network


def _texts(seed, n, least=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(30)]
    return [" ".join(rng.choice(words, rng.integers(least, 12))).encode() for _ in range(n)]


def _by_loops(net, text):
    """Embeddings summed, filters slid, the largest value of each kept, negative ones cut, and weighed."""
    vectors = []
    for word in toxicity.tokens(text):
        places, _ = toxicity.hashed_places([word])
        vectors.append(sum(np.asarray(net.embedding[p], dtype=np.float64) for p in places) / math.sqrt(len(places)))
    total, slot = float(net.constant), 0
    for width, number in toxicity.FILTERS.items():
        for f in range(number):
            best = -math.inf
            for start in range(len(vectors) - width + 1):
                best = max(best, sum(float(vectors[start + k] @ net.filters[width][k][:, f]) for k in range(width)))
            total += max(best + net.bias[slot], 0.0) * net.output[slot]
            slot += 1
    return total


@pytest.fixture(scope="module")
def trainer():
    texts = _texts(1, 24, 1)
    labels = np.array([int(b"wc" in t.split() or b"wbb" in t.split()) for t in texts])
    made = toxicity._Trainer(texts, labels)
    return made, texts, labels


def test_forward_pass_by_loops(trainer):
    made, texts, labels = trainer
    net = toxicity._Trainer(texts, labels).run(2)
    net.trained = True
    some = texts[:8] + [b"", b"one", "née voilà 日本".encode()]
    got = toxicity.Scorer(net).logits([t for t in some if toxicity.tokens(t)])
    want = [_by_loops(net, t) for t in some if toxicity.tokens(t)]
    assert np.allclose(got, want, atol=1e-4)


def test_gradients_by_finite_differences(trainer):
    made, texts, labels = trainer
    found = {}

    class Recorder:
        def __init__(self, name):
            self.name = name

        def step(self, gradient, rows=slice(None)):
            found[self.name] = (gradient.copy(), rows)

    made.rules = {name: Recorder(name) for name in made.rules}
    made.filter_rules = {w: Recorder(w) for w in made.filter_rules}
    net, chosen = made.net, np.arange(len(texts))
    made._batch(chosen)

    def loss():
        z = np.array([_by_loops(net, texts[i]) for i in chosen])
        return float(np.mean(np.logaddexp(0, z) - labels[chosen] * z))

    def slope(array, place, by=1e-5):
        kept = array[place]
        array[place] = kept + by
        high = loss()
        array[place] = kept - by
        low = loss()
        array[place] = kept
        return (high - low) / (2 * by)

    rng = np.random.default_rng(3)
    for name, array in (("bias", net.bias), ("output", net.output)):
        decay = toxicity.DECAY * net.output if name == "output" else 0.0
        plain = found[name][0] - decay
        for i in rng.integers(0, len(array), 4):
            assert plain[i] == pytest.approx(slope(array, i), abs=1e-6)
    for width, filters in net.filters.items():
        plain = found[width][0] - toxicity.DECAY * filters
        for _ in range(3):
            place = tuple(int(rng.integers(0, s)) for s in filters.shape)
            assert plain[place] == pytest.approx(slope(filters, place), abs=1e-6)
    gradient, rows = found["embedding"]
    plain = gradient - toxicity.DECAY * net.embedding[rows]
    strongest = np.argsort(-np.abs(plain).max(axis=1))[:3]
    for r in strongest:
        d = int(np.abs(plain[r]).argmax())
        assert plain[r, d] == pytest.approx(slope(net.embedding, (rows[r], d)), abs=1e-6)


# quality ranking


def test_features_by_plain_counting():
    texts = ["Plain words here.\nAnd a second line!", "AAA BBB | 12 34 | ## x x x", "é日本 word\n\nword\nword", "one", "A b! " * 40]
    for text in texts:
        data = text.encode()
        got = quality_bt.features(data)
        words = text.split()
        lines = [x for x in text.split("\n") if x.strip()]
        share = lambda test: sum(test(b) for b in data) / len(data)
        assert got[0] == pytest.approx(math.log(1 + len(words))) and got[1] == pytest.approx(math.log(1 + len(lines)))
        assert got[2] == pytest.approx(share(lambda b: b >= 128 or chr(b).isalpha()))
        assert got[3] == pytest.approx(share(lambda b: 65 <= b <= 90)) and got[4] == pytest.approx(share(lambda b: 48 <= b <= 57))
        assert got[7] == pytest.approx(share(lambda b: b == 33)) and got[8] == pytest.approx(share(lambda b: b == 124))
        sizes = [len(w.encode()) for w in words]
        assert got[9] == pytest.approx(sum(sizes) / len(sizes))
        assert got[10] == pytest.approx(math.sqrt(sum((s - got[9]) ** 2 for s in sizes) / len(sizes)))
        assert got[11] == pytest.approx(sizes.count(1) / len(sizes)) and got[13] == pytest.approx(max(sizes) / len(data))
        assert got[15] == pytest.approx(len(set(words)) / len(words)) and got[16] == pytest.approx(max(map(words.count, words)) / len(words))
        assert got[17] == pytest.approx(sum(a == b for a, b in zip(words, words[1:])) / len(words))
        assert got[21] == pytest.approx(1 - len(set(lines)) / len(lines))
    assert quality_bt.features(b" \n") == [0.0] * quality_bt.FEATURES


def test_newton_finds_what_gradient_descent_finds():
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(24, quality_bt.FEATURES))
    labels = (rows[:, 0] + rows[:, 3] + rng.normal(size=24) > 0).astype(int)
    ranker = quality_bt.fit(rows, labels)
    order = np.lexsort(rows.T[::-1])
    wide, truth = ranker.expand(rows[order]), labels[order]
    pairs = [(g, b) for g in np.flatnonzero(truth == 1) for b in np.flatnonzero(truth == 0)]
    diff = np.array([wide[g] - wide[b] for g, b in pairs])

    def objective(w):
        return sum(-math.log1p(math.exp(-float(d @ w))) for d in diff) - quality_bt.RIDGE / 2 * float(w @ w)

    weights = np.zeros(wide.shape[1])
    rate = 1.0 / (0.25 * np.linalg.norm(diff, 2) ** 2 + quality_bt.RIDGE)
    for _ in range(4000):
        weights += rate * (diff.T @ (1 / (1 + np.exp(diff @ weights))) - quality_bt.RIDGE * weights)
    assert objective(ranker.weights) >= objective(weights) - 1e-9
    assert objective(ranker.weights) == pytest.approx(objective(weights), abs=0.02)
    gradient = sum(d * (1 / (1 + math.exp(float(d @ ranker.weights)))) for d in diff) - quality_bt.RIDGE * ranker.weights
    assert np.abs(gradient).max() < 1e-4


def test_toxicity_learns_from_all_rows_in_shards(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(200)])
    rows = [(i, " ".join([*rng.choice(words, 12), *(["vile"] if i % 3 == 0 else [])]), "en", "s") for i in range(3600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(3600)], "doc_id long, quality int, toxic int")
    modulus, held = toxicity.HELD_OUT
    known = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % modulus != held]
    aside = [i for i in known if zlib.crc32(b"part" + rows[i][1].encode()) % 5 == 0]

    made, odds, judge = [], toxicity._odds, toxicity._judged
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 500)
    monkeypatch.setattr(toxicity, "_odds", lambda seen, total: made.append(("learnt", int(total.sum()))) or odds(seen, total))
    monkeypatch.setattr(toxicity, "_judged", lambda r, net: made.append(("judged", r.count())) or judge(r, net))
    found = toxicity.classify(docs, labels).where("held_out").collect()
    assert made == [("learnt", len(known) - len(aside)), ("judged", len(aside))]  # more than 3000 rows of either label or both: no sample
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in found]) > 0.97


def test_toxicity_passes_all_rows_as_often_whatever_their_number(spark, monkeypatch, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([(i, f"w{i} {'vile' if i % 3 == 0 else 'mild'}", int(i % 3 == 0)) for i in range(60)], "doc_id long, text string, label int").write.parquet(path)
    made, learned = [], toxicity._learned
    monkeypatch.setattr(toxicity, "_learned", lambda shared, epochs, seed: made.append(epochs) or learned(shared, epochs, seed))
    for total in ([40, 20], [40_000, 20_000], [4_000_000, 2_000_000]):
        for shards in (1, 2):
            made.clear()
            toxicity._learn(spark.read.parquet(path), np.array(total), shards)
            assert sum(made) == toxicity.EPOCHS


def test_ranges_are_summed():
    rng = np.random.default_rng(6)
    table, sizes = rng.normal(size=(50, 4)), rng.integers(1, 9, 30)
    flat, starts = rng.integers(0, 50, sizes.sum()), np.cumsum(sizes) - sizes
    want = np.array([table[flat[s : s + n]].sum(axis=0) for s, n in zip(starts, sizes)])
    assert np.allclose(toxicity._sums(table, flat, starts, sizes), want)
    order = rng.permutation(30)
    assert np.allclose(toxicity._sums(table, flat, starts[order], sizes[order]), want[order])


def test_texts_scored_together_score_as_alone():
    texts = [*_texts(2, 40), b"", None, b"one", b" ".join(_texts(3, 30)) * 40]
    net = toxicity._first_net(np.linspace(-1, 1, toxicity.BUCKETS), np.random.default_rng(1))
    together = toxicity.Scorer(net).logits(texts)
    assert np.allclose(together, [toxicity.Scorer(net).logits([t])[0] for t in texts], atol=1e-5)
