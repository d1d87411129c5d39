"""A quality classifier by Bradley-Terry ranking of documents.

A document's strength is linear in features of its whole text: shares of kinds of characters, word lengths, repetition of words, lines and
bytes, each also cut into bins at its quantiles. The weights are learnt from preference pairs, a document of
label 1 over one of label 0: the logistic loss of the difference of their features, by Newton's method. A quantile of the strengths becomes the
threshold, the one that parts the two labels best; the score is the logistic of the distance from it, so 0.5 is the threshold.

Learning uses a bounded sample (``ROWS_PER_CLASS`` rows of either label, ``MAX_CHARS`` characters, ``PAIRS`` pairs). Scoring is one
pass over the texts without a shuffle; weights are a few hundred numbers.

Defined results: a null text is scored as the empty text. Without labelled rows of both labels every score is 0.5. Repeated rows each give a row, with equal
scores. Only doc_id and text of a document are looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import crc_remainder, labelled_sample, map_batches, text_bytes

ROWS_PER_CLASS = 3_000
MAX_CHARS = 32_000_000
PAIRS = 40_000
BINS = 8
RIDGE = 1.0
HELD_OUT = (3, 1)  # crc32 of the id modulo 3 is 1

_LETTERS = bytes(c for c in range(256) if chr(c).isalpha() and c < 128) + bytes(range(128, 256))
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>@^~{}[]\\/_=+"
_MARKS = b".,;:!?'\"()-"
FEATURES = 24


def features(data: bytes) -> list[float]:
    """``FEATURES`` numbers of a whole text in UTF-8."""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    size = len(data)
    share = lambda chars: 1.0 - len(data.translate(None, chars)) / size
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    counts = Counter(words)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    pressed = 0
    packer = zlib.compressobj(1)
    for start in range(0, size, 1 << 20):
        pressed += len(packer.compress(data[start : start + (1 << 20)]))
    pressed += len(packer.flush())
    bare = [w.strip(_SYMBOLS + _MARKS) for w in counts]
    weights = list(counts.values())
    caps = sum(c for w, c in zip(bare, weights) if len(w) > 1 and w.isupper())
    empty = sum(c for w, c in zip(bare, weights) if not w)
    number = sum(c for w, c in zip(bare, weights) if w.isdigit())
    distinct = len(set(bare))
    return [
        np.log1p(n), np.log1p(len(lines)), share(_LETTERS), share(_UPPER), share(_DIGITS), share(_SYMBOLS), share(_MARKS),
        share(b"!"), share(b"|"), float(lengths.mean()), float(lengths.std()), float((lengths == 1).mean()), float((lengths > 20).mean()),
        float(lengths.max()) / size, distinct / n, len(counts) / n, max(weights) / n, repeats / n, caps / n, empty / n, number / n,
        1.0 - len(set(lines)) / len(lines), pressed / size, n / len(lines) / (1 + n),
    ]


@dataclass
class Ranker:
    """Cuts of the bins, centre and scale of the features, weights, threshold and slope of the score."""

    cuts: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    slope: float = 0.0

    def expand(self, rows: np.ndarray) -> np.ndarray:
        linear = np.clip((rows - self.centre) / self.scale, -8, 8)
        bins = (rows[:, :, None] > self.cuts[None]).reshape(len(rows), -1).astype(np.float64)
        return np.hstack([linear, bins])

    def strength(self, rows: np.ndarray) -> np.ndarray:
        return self.expand(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.zeros(0)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * (self.strength(rows) - self.threshold), -30, 30)))


def preference_pairs(labels: np.ndarray, pairs: int = PAIRS, seed: int = 11) -> np.ndarray:
    """Index pairs (better, worse): every document of label 1 and of label 0 takes part as evenly as ``pairs`` allows."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if len(good) * len(bad) <= pairs:
        return np.array([(g, b) for g in good for b in bad], dtype=np.int64).reshape(-1, 2)
    side = lambda index: np.concatenate([rng.permutation(index) for _ in range(-(-pairs // len(index)))])[:pairs]
    return np.stack([side(good), side(bad)], axis=1)


def fit(rows: np.ndarray, labels: np.ndarray, prior: float | None = None) -> Ranker:
    """Learn from feature rows and labels 0 or 1. ``prior``: the share of label 1 where the rows do not show it."""
    order = np.lexsort(rows.T[::-1])
    rows, labels = rows[order], labels[order]
    cuts = np.quantile(rows, np.arange(1, BINS) / BINS, axis=0).T if len(rows) else np.zeros((FEATURES, BINS - 1))
    centre = rows.mean(axis=0) if len(rows) else np.zeros(FEATURES)
    scale = rows.std(axis=0) + 1e-6 if len(rows) else np.ones(FEATURES)
    ranker = Ranker(cuts, centre, scale, np.zeros(FEATURES * BINS))
    if len(np.unique(labels)) < 2:
        return ranker
    pairs = preference_pairs(labels)
    wide = ranker.expand(rows)
    diff = wide[pairs[:, 0]] - wide[pairs[:, 1]]
    for _ in range(25):
        p = 1.0 / (1.0 + np.exp(-np.clip(diff @ ranker.weights, -30, 30)))
        gradient = diff.T @ (1.0 - p) - RIDGE * ranker.weights
        curvature = (diff * (p * (1.0 - p))[:, None]).T @ diff + RIDGE * np.eye(diff.shape[1])
        step = np.linalg.solve(curvature, gradient)
        ranker.weights += step
        if np.abs(step).max() < 1e-6:
            break
    strength = wide @ ranker.weights
    levels = np.quantile(strength, np.linspace(0.005, 0.995, 199), method="midpoint")
    good, bad = strength[labels == 1], strength[labels == 0]
    parted = np.array([(good >= t).mean() + (bad < t).mean() for t in levels])
    best = levels[parted >= parted.max() - 1e-9]
    ranker.threshold = float((best.min() + best.max()) / 2)
    spread = np.median(good) - np.median(bad)
    ranker.slope = float(6.0 / max(spread, 1e-6))
    return ranker


def feature_rows(texts: Iterable[bytes | None]) -> np.ndarray:
    rows = [features(t or b"") for t in texts]
    return np.array(rows, dtype=np.float64).reshape(len(rows), FEATURES)


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, max_chars: int = MAX_CHARS) -> Ranker:
    """Learn from the labelled documents that are not held out."""
    modulus, held = HELD_OUT
    marks = labels.where(crc_remainder("doc_id", modulus) != held)
    sample = labelled_sample(docs.select("doc_id", "text", F.lit("").alias("lang")), marks, "quality", rows_per_class, max_chars)
    made = map_batches(sample, lambda b: {"features": feature_rows(text_bytes(b, "text")).tolist()}, "features array<double>", ["label"])
    rows = made.collect()  # at most 2 * rows_per_class rows of FEATURES numbers
    matrix = np.array([r["features"] for r in rows], dtype=np.float64).reshape(len(rows), FEATURES)
    return fit(matrix, np.array([r["label"] for r in rows], dtype=np.int64))


def scored(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id and score of every document."""
    build = lambda batch: {"score": ranker.score(feature_rows(text_bytes(batch, "text"))).tolist()}
    return map_batches(docs.select("doc_id", "text"), build, "score double", ["doc_id"])


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per document."""
    modulus, held = HELD_OUT
    found = scored(docs, train(docs, labels))
    return found.select(
        "doc_id", (crc_remainder("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
