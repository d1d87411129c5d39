"""A convolutional text classifier for toxicity, trained in numpy.

Words (letters and digits, A-Z lower-cased) are embedded as the mean of hashed vectors: one for the whole word and one for each of its
character n-grams, so that unseen forms of a word are near the seen ones. A word longer than ``WORD_BYTES`` (a run of a script without spaces,
a joined-up token) is read as overlapping pieces, each a word of its own, so that pooling sees every part of it. Filters of several widths run over the words, each is
max-pooled over the whole text, and a logistic layer gives the logit. The language decides nothing but the threshold: on part of the
training rows one threshold is calibrated for all and one per language with enough toxic rows. The score is shifted so that the threshold for
all is ``THRESHOLD``.

Learning uses every labelled row that is not held out, in tasks: rows are dealt into shards of about ``SHARD_ROWS`` and ``SHARD_CHARS`` and written; each task learns on from the
common weights, and the changes are averaged weight by weight, in ``EPOCHS`` passes over all rows, however many they are. Counts of buckets and of scores by label, from
which the start and the thresholds come, are sums over all such rows; scores are counted in steps of 1 / ``STEPS``. The driver holds the
weights, never a text. Scoring is one pass over the texts without a shuffle. A text is worked off in pieces of ``PIECE`` words that overlap by the widest filter, so memory does not grow
with its length.

Defined results: null and empty texts have no words and are scored as a text without any; repeated rows get equal scores. Without labelled rows
of both labels every score is 0. Only doc_id, text and, for the threshold, lang are looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import crc_remainder, map_batches, text_bytes
from twinfold.session import stage

SHARD_ROWS = 6_000
SHARD_CHARS = 24_000_000
CHUNK_STEP = 500
FIXED = float(1 << 40)  # changes are summed as integers, so that their order does not matter
STEPS = 1024
BUCKETS = 1 << 15
DIM = 16
FILTERS = {1: 16, 2: 8, 3: 8}  # width: number of filters
EPOCHS = 6
BATCH = 32
RATE = 0.05
DECAY = 1e-5
THRESHOLD = 0.3
HELD_OUT = (4, 2)  # crc32 of the id modulo 4 is 2
MIN_POSITIVES = 20  # toxic rows that a language needs for a threshold of its own
PIECE = 50_000
CACHED_WORDS = 100_000
HASHED = 10_000  # words hashed at a time
WORD_BYTES = 40  # a longer word is read in pieces of so many bytes
WORD_STEP = 24  # from one piece of a word to the next

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TAPS = [(w, k) for w in FILTERS for k in range(w)]
_WIDE = sum(FILTERS[w] for w, _ in _TAPS)
_POOLED = sum(FILTERS.values())


def tokens(text: bytes | None) -> list[bytes]:
    """Words in order; one of more than ``WORD_BYTES`` bytes as its pieces, which cover it to its end."""
    words = _WORD.findall(text.lower()) if text else []
    if not words or max(map(len, words)) <= WORD_BYTES:
        return words
    overlap = WORD_BYTES - WORD_STEP
    return [w[i : i + WORD_BYTES] for w in words for i in range(0, max(len(w) - overlap, 1), WORD_STEP)]


def hashed_places(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and how many it has: the whole word, and its n-grams of 4 and 5 bytes with both ends marked."""
    parts = [_hashed_places(words[i : i + HASHED]) for i in range(0, len(words), HASHED)] or [_hashed_places([])]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _hashed_places(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    marked = [b"<" + w + b">" for w in words]
    sizes = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    data = np.frombuffer(b"".join(marked) + bytes(4), dtype=np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    room = np.cumsum(sizes)[owner] - np.arange(len(owner))
    shifted = [data[k : len(data) - 4 + k] << np.uint64(8 * k) for k in range(5)]
    four = shifted[0] | shifted[1] | shifted[2] | shifted[3]
    whole = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words)) << np.uint64(8)
    grams = np.concatenate([whole, four[room >= 4], (four | shifted[4])[room >= 5] + np.uint64(1)])
    owners = np.concatenate([np.arange(len(words)), owner[room >= 4], owner[room >= 5]])
    mixed = (grams + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    places = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
    order = np.argsort(owners, kind="stable")
    return (places[order] % np.uint64(BUCKETS)).astype(np.int32), np.bincount(owners, minlength=len(words))


def _sums(table: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sums of some ranges of ``table[flat]``, added up in order; ranges that begin at ``starts`` have ``sizes`` rows, one at least."""
    order = np.argsort(-sizes, kind="stable")
    starts, counts = starts[order], np.bincount(sizes)
    total = table[flat[starts]]
    left = len(sizes)
    for k in range(1, len(counts) - 1):
        left -= counts[k]
        total[:left] += table[flat[starts[:left] + k]]
    out = np.empty_like(total)
    out[order] = total
    return out


@dataclass
class Net:
    embedding: np.ndarray  # BUCKETS x DIM
    filters: dict[int, np.ndarray]  # width: width x DIM x number
    bias: np.ndarray  # one per filter
    output: np.ndarray  # one per filter
    constant: float = 0.0
    shift: float = 0.0
    scale: float = 1.0
    thresholds: dict[str, float] = field(default_factory=dict)
    trained: bool = False

    def taps(self) -> np.ndarray:
        """DIM x _WIDE: what a word adds to each filter at each place of its width."""
        return np.hstack([self.filters[w][k] for w, k in _TAPS]).astype(np.float32)

    def pooled(self, projected: np.ndarray) -> np.ndarray:
        """Max-pooled filters of one piece; ``projected`` is words x _WIDE."""
        n = len(projected)
        out, column = [], 0
        for width, number in FILTERS.items():
            if n >= width:
                total = projected[: n - width + 1, column : column + number]
                for k in range(1, width):
                    at = column + k * number
                    total = total + projected[k : n - width + 1 + k, at : at + number]
                out.append(total.max(axis=0))
            else:
                out.append(np.full(number, -np.inf, dtype=projected.dtype))
            column += width * number
        return np.concatenate(out)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        active = np.maximum(pooled + self.bias, 0.0)  # -inf, a filter wider than the text, counts as 0
        return active @ self.output + self.constant


def _seen(docs: list[np.ndarray], flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """2 x BUCKETS: the documents of either label that have a bucket."""
    seen = np.zeros((2, BUCKETS))
    starts = np.cumsum(sizes) - sizes
    for words, label in zip(docs, labels):
        if len(words):
            used = np.unique(words)
            n = sizes[used]
            spots = np.repeat(starts[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            seen[label][np.unique(flat[spots])] += 1
    return seen


def _odds(seen: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How much likelier a bucket is in documents of label 1, smoothed and cut at 4."""
    share = (seen + 1.0) / (total[:, None] + 2.0)
    odds = np.log(share[1] / share[0])
    return np.clip(np.where(seen.sum(axis=0) > 1, odds, 0.0), -4, 4)


def _first_net(odds: np.ndarray, rng: np.random.Generator) -> Net:
    embedding = rng.normal(0, 0.1, (BUCKETS, DIM))
    embedding[:, 0] = 0.25 * odds  # a start from which pooling already points at the telling words
    filters = {w: rng.normal(0, 0.2, (w, DIM, n)) for w, n in FILTERS.items()}
    filters[1][0, 0, : FILTERS[1] // 2] += 1.0
    output = rng.normal(0, 0.1, _POOLED)
    output[: FILTERS[1] // 2] += 0.3
    return Net(embedding, filters, np.zeros(_POOLED), output)


class _Words:
    """Rows of projected words, computed once per distinct word and piece of cache."""

    def __init__(self, net: Net):
        self.net, self.matrix = net, net.taps()
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.rows = np.zeros((1024, _WIDE), dtype=np.float32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > CACHED_WORDS:
            self.clear()
        index = self.index
        new = [w for w in set(words) if w not in index]
        if new:
            flat, sizes = hashed_places(new)
            sums = np.add.reduceat(self.net.embedding[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
            first = len(index)
            while first + len(new) > len(self.rows):
                self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
            self.rows[first : first + len(new)] = (sums / np.sqrt(sizes)[:, None]) @ self.matrix
            index.update(zip(new, range(first, first + len(new))))
        return np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))

    def rows_of(self, pieces: list[list[bytes]]) -> Iterator[np.ndarray]:
        """The rows of each of some pieces, whose new words are projected together."""
        numbers = self.numbers([w for piece in pieces for w in piece])  # may grow or renew the rows
        at = 0
        for piece in pieces:
            yield self.rows[numbers[at : at + len(piece)]]
            at += len(piece)


class Scorer:
    _built: dict[str, Scorer] = {}

    def __init__(self, net: Net):
        self.net, self.words = net, _Words(net)

    @classmethod
    def of(cls, key: str, shared) -> Scorer:
        if key not in cls._built:
            cls._built.clear()
            cls._built[key] = cls(shared.value)
        return cls._built[key]

    def logits(self, texts: list[bytes | None]) -> np.ndarray:
        pooled = np.full((len(texts), _POOLED), -np.inf)
        overlap = max(FILTERS) - 1
        held: list[tuple[int, list[bytes]]] = []

        def pool() -> None:
            for (i, _), rows in zip(held, self.words.rows_of([piece for _, piece in held])):
                pooled[i] = np.maximum(pooled[i], self.net.pooled(rows))
            held.clear()

        room = HASHED
        for i, text in enumerate(texts):
            words = tokens(text)
            for start in range(0, len(words), PIECE):
                held.append((i, words[start : start + PIECE + overlap]))
                room -= len(held[-1][1])
                if room <= 0:
                    pool()
                    room = HASHED
        pool()
        return self.net.logit(pooled)

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if not self.net.trained:
            return np.zeros(len(texts))
        z = self.net.scale * (self.logits(texts) - self.net.shift) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class _Adagrad:
    """Step sizes by the squares of all gradients so far, apart for every weight."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.seen = weights, np.full_like(weights, 1e-2)

    def step(self, gradient: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        self.seen[rows] += gradient**2
        self.weights[rows] -= RATE * gradient / np.sqrt(self.seen[rows])


class _Trainer:
    def __init__(self, texts: list[bytes], labels: np.ndarray, seed: int = 5, start: Net | None = None):
        rng = np.random.default_rng(seed)
        self.labels, self.rng = labels, rng
        number: dict[bytes, int] = {}
        self.docs = [self._numbered(tokens(t), number) for t in texts]
        self.flat, self.sizes = hashed_places(list(number))
        del number
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.net = start or _first_net(_odds(self.counts(), np.bincount(labels, minlength=2)), rng)
        self.rules = {"embedding": _Adagrad(self.net.embedding), "bias": _Adagrad(self.net.bias), "output": _Adagrad(self.net.output)}
        self.filter_rules = {w: _Adagrad(f) for w, f in self.net.filters.items()}
        self.constant = np.array([self.net.constant])
        self.rules["constant"] = _Adagrad(self.constant)

    @staticmethod
    def _numbered(words: list[bytes], number: dict[bytes, int]) -> np.ndarray:
        for w in dict.fromkeys(words):
            number.setdefault(w, len(number))
        return np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=len(words))

    def counts(self) -> np.ndarray:
        return _seen(self.docs, self.flat, self.sizes, self.labels)

    def _batch(self, chosen: np.ndarray) -> None:
        net = self.net
        joined = np.concatenate([self.docs[i] for i in chosen])
        place = np.zeros(len(self.sizes), dtype=np.int32)
        place[joined] = 1
        used = np.flatnonzero(place)
        place[used] = np.arange(len(used))
        inverse, sizes, starts = place[joined], self.sizes[used], self.starts[used]
        root = np.sqrt(sizes)[:, None]
        vectors = _sums(net.embedding, self.flat, starts, sizes) / root
        taps = np.hstack([net.filters[w][k] for w, k in _TAPS])
        projected = vectors @ taps
        pooled = np.full((len(chosen), _POOLED), -np.inf)
        spots: list[list[tuple[int, int, int, np.ndarray, np.ndarray]]] = []
        at = 0
        for row, i in enumerate(chosen):
            ids = inverse[at : at + len(self.docs[i])]
            at += len(ids)
            rows, column, slot, mine = projected[ids], 0, 0, []
            for width, number in FILTERS.items():
                if len(ids) >= width:
                    total = rows[: len(ids) - width + 1, column : column + number]
                    for k in range(1, width):
                        total = total + rows[k : len(ids) - width + 1 + k, column + k * number : column + (k + 1) * number]
                    best = total.argmax(axis=0)
                    pooled[row, slot : slot + number] = total[best, np.arange(number)]
                    mine.append((width, column, slot, best, ids))
                column += width * number
                slot += number
            spots.append(mine)
        before = pooled + net.bias
        active = np.maximum(before, 0.0)
        z = active @ net.output + self.constant[0]
        error = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - self.labels[chosen]) / len(chosen)
        back = np.where(before > 0, error[:, None] * net.output[None], 0.0)
        cells, values = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        for row, mine in enumerate(spots):
            for width, column, slot, best, ids in mine:
                number = FILTERS[width]
                for k in range(width):
                    cells.append(ids[best + k].astype(np.int64) * _WIDE + column + k * number + np.arange(number))
                    values.append(back[row, slot : slot + number])
        change = np.bincount(np.concatenate(cells), np.concatenate(values), minlength=projected.size).reshape(projected.shape)
        hit = np.flatnonzero(np.abs(change).sum(axis=1))
        toward_taps = vectors[hit].T @ change[hit]
        toward_words = (change[hit] @ taps.T) / root[hit]
        many = sizes[hit]
        own = self.flat[np.repeat(starts[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        rows, at = np.unique(own, return_inverse=True)
        by = np.repeat(toward_words, many, axis=0)
        moved = np.stack([np.bincount(at, by[:, d], minlength=len(rows)) for d in range(DIM)], axis=1)
        self.rules["output"].step(active.T @ error + DECAY * net.output)
        self.rules["bias"].step(back.sum(axis=0))
        self.rules["constant"].step(np.array([error.sum()]))
        self.rules["embedding"].step(moved + DECAY * net.embedding[rows], rows)
        column = 0
        for width, number in FILTERS.items():
            gradient = np.stack([toward_taps[:, column + k * number : column + (k + 1) * number] for k in range(width)])
            self.filter_rules[width].step(gradient + DECAY * net.filters[width])
            column += width * number
        net.constant = float(self.constant[0])

    def run(self, epochs: int = EPOCHS) -> Net:
        readable = np.array([i for i, d in enumerate(self.docs) if len(d)], dtype=np.int64)
        for _ in range(epochs):
            order = self.rng.permutation(readable)
            for start in range(0, len(order), BATCH):
                self._batch(order[start : start + BATCH])
        return self.net


def best_cut(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """The threshold with the best F1, in the middle of those that share it, and that F1."""
    levels = np.unique(scores)
    middles = np.concatenate([levels[:1] - 1.0, (levels[1:] + levels[:-1]) / 2, levels[-1:] + 1.0])
    order = np.argsort(scores)
    hit = np.concatenate([[0.0], np.cumsum((weights * labels)[order])])
    passed = np.concatenate([[0.0], np.cumsum(weights[order])])
    below = np.searchsorted(scores[order], middles)
    true = hit[-1] - hit[below]
    called = passed[-1] - passed[below]
    f1 = 2 * true / np.maximum(called + hit[-1], 1e-12)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    run = best[: np.argmax(np.append(np.diff(best), 2) > 1) + 1]
    return float((middles[run[0]] + middles[run[-1]]) / 2) if len(run) > 1 else float(middles[run[0]]), float(f1.max())


def f1_at(cut: float, scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    called = scores >= cut
    true = (weights * labels)[called].sum()
    return 2 * true / max(weights[called].sum() + (weights * labels).sum(), 1e-12)


def fit(texts: list[bytes], labels: np.ndarray, langs: list[str | None], toxic_share: float = 0.5) -> Net:
    """Train on four fifths of the rows (equal texts together) and calibrate on the rest, if it has enough toxic rows.

    ``toxic_share`` is the share of label 1 among all labelled rows; the rows here may hold another share.
    """
    aside = np.array([zlib.crc32(b"part" + t) % 5 == 0 for t in texts], dtype=bool)
    if labels[aside].sum() < MIN_POSITIVES or len(set(labels[~aside].tolist())) < 2:
        aside[:] = False  # too few to calibrate on: learn from all, and calibrate on what was learnt
    if len(set(labels[~aside].tolist())) < 2:
        return Net(np.zeros((BUCKETS, DIM)), {w: np.zeros((w, DIM, n)) for w, n in FILTERS.items()}, np.zeros(_POOLED), np.zeros(_POOLED))
    learn = np.flatnonzero(~aside)
    net = _Trainer([texts[i] for i in learn], labels[learn]).run()
    net.embedding = net.embedding.astype(np.float32)
    net.trained = True
    judged = np.flatnonzero(aside) if len(set(labels[aside].tolist())) == 2 else learn
    truth = labels[judged].astype(np.float64)
    share = truth.mean()
    weights = np.where(truth == 1, toxic_share / share, (1 - toxic_share) / (1 - share))
    scorer = Scorer(net)
    net.shift, _ = best_cut(scorer.logits([texts[i] for i in judged]), truth, weights)
    scores = scorer.scores([texts[i] for i in judged])
    for lang in sorted({langs[i] for i in judged} - {None}):
        mine = np.array([langs[i] == lang for i in judged])
        if truth[mine].sum() >= MIN_POSITIVES and truth[mine].sum() < mine.sum():
            cut, f1 = best_cut(scores[mine], truth[mine], weights[mine])
            if f1 > f1_at(THRESHOLD, scores[mine], truth[mine], weights[mine]) + 1e-9:
                net.thresholds[lang] = min(max(cut, 0.05), 0.95)
    return net


def _blank() -> Net:
    return Net(np.zeros((BUCKETS, DIM)), {w: np.zeros((w, DIM, n)) for w, n in FILTERS.items()}, np.zeros(_POOLED), np.zeros(_POOLED))


def _dense(net: Net) -> np.ndarray:
    """All weights but the embedding, as rows of DIM numbers."""
    flat = np.concatenate([*(net.filters[w].ravel() for w in FILTERS), net.bias, net.output, [net.constant]])
    return np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM)


def _moved(net: Net, change: dict[int, np.ndarray]) -> Net:
    """``net`` with the changes of its rows: those of the embedding, then those of ``_dense``."""
    embedding, dense = net.embedding.copy(), _dense(net)
    for place, by in change.items():
        (embedding if place < BUCKETS else dense)[place % BUCKETS] += by
    flat, at, filters = dense.ravel(), 0, {}
    for w, f in net.filters.items():
        filters[w] = flat[at : at + f.size].reshape(f.shape).copy()
        at += f.size
    return Net(embedding, filters, flat[at : at + _POOLED].copy(), flat[at + _POOLED : at + 2 * _POOLED].copy(), float(flat[at + 2 * _POOLED]))


def _chunks(batches):
    """(texts, labels) of at most ``SHARD_ROWS`` rows and about ``SHARD_CHARS`` bytes at a time, each in order of id and text."""
    held, rows, size = [], 0, 0

    def chunk():
        table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        parts = table.combine_chunks().to_batches()
        return [t for b in parts for t in text_bytes(b, "text")], table.column("label").to_numpy().astype(np.int64)

    for whole in batches:
        for start in range(0, whole.num_rows, CHUNK_STEP):
            batch = whole.slice(start, CHUNK_STEP)
            if held and (rows + batch.num_rows > SHARD_ROWS or size > SHARD_CHARS):
                yield chunk()
                held, rows, size = [], 0, 0
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
    if held:
        yield chunk()


def _counted(batches):
    """(place, clean, toxic): the task function."""
    seen = np.zeros((2, BUCKETS), dtype=np.int64)
    for texts, labels in _chunks(batches):
        seen += _Trainer(texts, labels, start=_blank()).counts().astype(np.int64)
    used = np.flatnonzero(seen.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[0][used]), pa.array(seen[1][used])], ["place", "clean", "toxic"])


def _learned(shared, epochs: int, seed: int):
    """The task function: what the weights change by where a task's rows are learnt from; one row for each weight row that changes."""

    def run(batches):
        before = shared.value
        after = _moved(before, {})
        for texts, labels in _chunks(batches):
            after = _Trainer(texts, labels, seed, after).run(epochs)
        change = np.vstack([after.embedding - before.embedding, _dense(after) - _dense(before)])
        used = np.flatnonzero(np.abs(change).sum(axis=1))
        columns = np.rint(change[used] * FIXED).astype(np.int64).T
        yield pa.RecordBatch.from_arrays([pa.array(used), *map(pa.array, columns)], ["place", *(f"c{i}" for i in range(DIM))])

    return run


def _learn(rows: DataFrame, total: np.ndarray, shards: int) -> Net:
    """The weights learnt from all of ``rows`` (doc_id, text, label), a written table whose splits are the shards."""
    spark, dealt = rows.sparkSession, rows.select("doc_id", "text", "label")
    counts = dealt.mapInArrow(_counted, "place bigint, clean bigint, toxic bigint")
    seen = np.zeros((2, BUCKETS))
    for place, clean, toxic in counts.groupBy("place").agg(F.sum("clean"), F.sum("toxic")).collect():  # BUCKETS rows at most
        seen[:, place] = clean, toxic
    net = _first_net(_odds(seen, total), np.random.default_rng(5))
    schema = "place bigint, " + ", ".join(f"c{i} bigint" for i in range(DIM))
    for turn in range(1 if shards == 1 else EPOCHS):
        shared = spark.sparkContext.broadcast(net)
        moves = dealt.mapInArrow(_learned(shared, EPOCHS if shards == 1 else 1, 5 + turn), schema)
        sums = moves.groupBy("place").agg(F.count(F.lit(1)), *[F.sum(f"c{i}") for i in range(DIM)]).collect()  # a row for each weight row
        net = _moved(net, {r[0]: np.array(r[2:], dtype=np.float64) / FIXED / r[1] for r in sums})
        shared.unpersist()
    return net


def _judged(rows: DataFrame, net: Net) -> list:
    """(lang, label, step, n): how many of ``rows`` have a logit within a step."""
    shared, key = rows.sparkSession.sparkContext.broadcast(net), f"judged-{zlib.crc32(net.embedding.tobytes())}"

    def build(batch: pa.RecordBatch) -> dict:
        z = Scorer.of(key, shared).logits(text_bytes(batch, "text"))
        return {"step": np.floor(np.clip(z, -30, 30) * STEPS).astype(np.int64).tolist()}

    steps = map_batches(rows.select("lang", "label", "text"), build, "step bigint", ["lang", "label"])
    return steps.groupBy("lang", "label", "step").agg(F.count(F.lit(1)).alias("n")).orderBy("step", "lang", "label").collect()


def learning_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """Every labelled document that is not held out, written as (doc_id, text, lang, label, aside), and the number of shards it is dealt into.

    A doc_id labelled twice counts by its larger label. The texts are dealt once, by the join.
    """
    modulus, held = HELD_OUT
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_remainder("doc_id", modulus) != held))
    known = stage(known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")), "known-toxic")
    docs = docs.where(F.col("doc_id").isNotNull() & (crc_remainder("doc_id", modulus) != held))
    chars, n = docs.agg(F.sum(F.length("text").cast("bigint")), F.count(F.lit(1))).first()
    wanted = known.count()
    shards = max(1, -(-wanted // SHARD_ROWS), -(-(chars or 0) * min(wanted, n) // max(n * SHARD_CHARS, 1)))
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang").repartition(shards, "doc_id")
    met = text.join(known.repartition(shards, "doc_id").hint("merge"), "doc_id")
    aside = F.pmod(F.crc32(F.concat(F.lit("part"), F.col("text")).cast("binary")), F.lit(5)) == 0
    return stage(met.withColumn("aside", aside), "labelled-toxic"), shards


def train(docs: DataFrame, labels: DataFrame) -> Net:
    """Learn from four fifths of all labelled documents that are not held out (equal texts together) and calibrate on the rest."""
    rows, shards = learning_rows(docs, labels)
    held = {(r["aside"], r["label"]): r["n"] for r in rows.groupBy("aside", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    number = lambda aside: np.array([held.get((aside, 0), 0), held.get((aside, 1), 0)])
    apart = number(True)[1] >= MIN_POSITIVES and number(False).min() > 0
    learn, total = (rows.where("NOT aside"), number(False)) if apart else (rows, number(True) + number(False))
    if total.min() == 0:
        return _blank()
    net = _learn(learn, total, shards)
    net.embedding = net.embedding.astype(np.float32)
    net.trained = True
    steps = _judged(rows.where("aside") if apart and number(True).min() > 0 else learn, net)
    z = np.array([(r["step"] + 0.5) / STEPS for r in steps])
    truth, weights = np.array([float(r["label"]) for r in steps]), np.array([float(r["n"]) for r in steps])
    net.shift, _ = best_cut(z, truth, weights)
    scores = 1.0 / (1.0 + np.exp(-np.clip(z - net.shift + np.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))
    for lang in sorted({r["lang"] for r in steps} - {None}):
        mine = np.array([r["lang"] == lang for r in steps])
        positives = (truth * weights)[mine].sum()
        if positives >= MIN_POSITIVES and positives < weights[mine].sum():
            cut, f1 = best_cut(scores[mine], truth[mine], weights[mine])
            if f1 > f1_at(THRESHOLD, scores[mine], truth[mine], weights[mine]) + 1e-9:
                net.thresholds[lang] = min(max(cut, 0.05), 0.95)
    return net


def scored(docs: DataFrame, net: Net, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with score, threshold (by lang) and rejected, for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    key = f"{docs.sparkSession.sparkContext.applicationId}-{zlib.crc32(net.embedding.tobytes())}-{net.shift!r}"

    def build(batch: pa.RecordBatch) -> dict:
        scores = Scorer.of(key, shared).scores(text_bytes(batch, "text"))
        cuts = np.array([net_thresholds.get(lang, THRESHOLD) for lang in batch.column("lang").to_pylist()])
        return {"score": scores.tolist(), "threshold": cuts.tolist(), "rejected": (scores >= cuts).tolist()}

    net_thresholds = dict(net.thresholds)
    columns = list(dict.fromkeys([*keep, "text", "lang"]))
    return map_batches(docs.select(*columns), build, "score double, threshold double, rejected boolean", list(keep))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, threshold, rejected; one row per document."""
    modulus, held = HELD_OUT
    found = scored(docs, train(docs, labels))
    return found.select(
        "doc_id", (crc_remainder("doc_id", modulus) == held).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "threshold", "rejected",
    )
