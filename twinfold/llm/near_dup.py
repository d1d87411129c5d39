"""Near-duplicate documents by MinHash, with an inverted join over signature coordinates.

1. Every text becomes its set of word shingles, a signature of ``COORDINATES`` minima and a parity sketch (bit i is the parity of the shingles that
   hash to i). Documents with equal sets are one class from here on.
2. Classes are posted under their (coordinate, value) pairs. Linked sets agree in at least ``least_matches`` coordinates (short of a chance
   below ``MISS``), so the pairs can be found under the rarest COORDINATES - least_matches + 1 of a class's pairs: the prefix.
   Pairs that occur once have no partner and are never shuffled.
3. Under each pair collisions are counted on whole signatures. A pair of classes is taken up only under the first coordinate that both prefixes share
   and skipped under all others; it is kept with enough matches, sizes near enough, and a sketch distance that does not rule it out. (Two sets
   differ in at least as many shingles as their parity sketches differ in bits, so nothing that is linked is lost here.)
4. Under each pair, a spanning forest of the kept pairs, nearest first, is confirmed on the full sets. Where one of its links fails, all kept
   pairs of that posting list between still different components are confirmed in a second round. So a group of many near copies is
   not expanded into all its pairs, and no link between different components stays unexamined.
5. Confirmed links are joined to components.

A posting list with more than ``BLOCK`` classes is cut into blocks, and each pair of blocks is one unit of work.

Defined results: a null or empty text has an empty set and is linked with nothing. Rows with one doc_id are one document as far as components go. A
row with a null doc_id has a null component, unless it is linked to one with an id. Repeated rows each give a row. Other columns are
not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import map_batches, text_bytes
from twinfold.llm.components import connected
from twinfold.operators.skew import lookup_join
from twinfold.session import stage

COORDINATES = 20
MISS = 1e-8
BLOCK = 2048
MAX_SKETCH_BITS = 1 << 20

_MIXERS = np.random.default_rng(20).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(21).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest number of matching coordinates that a pair of this similarity falls short of with a chance below ``miss``."""
    j, chance, k = percent / 100, 0.0, 0
    while k < coordinates:
        chance += math.comb(coordinates, k) * j**k * (1 - j) ** (coordinates - k)
        if chance > miss:
            break
        k += 1
    return max(1, k)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The distinct ``size``-word shingles of a text as sorted 64-bit hashes; all words as one where there are fewer."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    width = min(n, size)
    total = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total += hashed[k : n - width + 1 + k] * _PLACES[k]
    return np.unique(_mixed(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    return np.array([(shingles * m).min() for m in _MIXERS], dtype=np.uint64)


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the shingles over a power of two of bits, at least two bits a shingle up to MAX_SKETCH_BITS."""
    bits = min(MAX_SKETCH_BITS, max(64, 1 << (2 * len(shingles) - 1).bit_length()))
    parity = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128(shingles.tobytes()).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def prints(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, d1 and d2 (the set's digest), signature, sketch; the last four null for an empty set."""

    def build(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n_shingles": [], "d1": [], "d2": [], "signature": [], "sketch": []}
        for text in text_bytes(batch, "text"):
            found = shingle_set(text, size)
            empty = not len(found)
            d1, d2 = (None, None) if empty else set_digest(found)
            out["n_shingles"].append(len(found))
            out["d1"].append(d1)
            out["d2"].append(d2)
            out["signature"].append(None if empty else (_mixed(signature(found)) >> np.uint64(32)).astype(np.uint32).tobytes())
            out["sketch"].append(None if empty else sketch(found))
        return out

    schema = "n_shingles bigint, d1 bigint, d2 bigint, signature binary, sketch binary"
    return map_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), build, schema, ["doc_id", "text_hash"])


def _postings(classes: DataFrame) -> DataFrame:
    """(node, key): a class under each coordinate and value; the coordinate is in the bits above the value's 32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = np.arange(COORDINATES, dtype=np.int64)[None, :] << 32
        for batch in batches:
            if batch.num_rows:
                values = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)
                nodes = np.repeat(np.asarray(batch.column(0)), COORDINATES)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array((above | values).ravel())], ["node", "key"])

    return classes.select("node", "signature").mapInArrow(run, "node bigint, key bigint")


def _posted(classes: DataFrame, least: int) -> DataFrame:
    """Prefix postings by unit of work: (key, i, j, right, node, mask, n_shingles, signature, sketch).

    ``mask`` has a bit for each coordinate in the class's prefix. ``i`` and ``j`` are the two blocks that meet; ``right`` tells the side.
    """
    posts = stage(_postings(classes), "posts")
    counts = stage(posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "lists")
    table = counts.select("key", F.col("n").alias("list"), "n")
    shared = lookup_join(posts, table, "key", "n", "node")
    entries = F.sort_array(F.collect_list(F.struct("list", "key")))
    # Pairs that occur once stand first in a class's order, so of the r shared ones the first r - (least - 1) are in the prefix.
    held = shared.groupBy("node").agg(entries.alias("entries")).where(F.size("entries") >= least)
    prefix = held.select("node", F.slice("entries", F.lit(1), F.size("entries") - (least - 1)).alias("prefix"))
    bits = F.aggregate("prefix", F.lit(0).cast("bigint"), lambda m, e: m.bitwiseOR(F.pow(F.lit(2.0), F.shiftright(e["key"], 32)).cast("bigint")))
    rows = prefix.select("node", bits.alias("mask"), F.explode("prefix").alias("entry"))
    blocks = F.ceil(F.col("entry.list") / BLOCK).cast("int")
    placed = rows.select("node", "mask", F.col("entry.key").alias("key"), blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    spread = placed.select("node", "mask", "key", "own", F.explode(others).alias("other"))
    unit = spread.select(
        "node", "mask", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("right")
    )
    return unit.join(classes.select("node", "n_shingles", "signature", "sketch"), "node")


class _Unit:
    """The classes that meet under one posting (or one pair of its blocks), and the pairs among them that can be linked."""

    def __init__(self, key: int, rows: list[dict], percent: int, least: int):
        self.coordinate, self.percent, self.least = key >> 32, percent, least
        self.nodes = [r["node"] for r in rows]
        self.split = rows[0]["i"] != rows[0]["j"]
        self.right = np.array([r["right"] for r in rows], dtype=bool)
        self.sizes = np.array([r["n_shingles"] for r in rows], dtype=np.int64)
        self.values = np.frombuffer(b"".join(r["signature"] for r in rows), dtype=np.uint32).reshape(len(rows), -1)
        masks = np.array([r["mask"] for r in rows], dtype=np.int64)
        self.earlier = ((masks[:, None] >> np.arange(self.coordinate)[None, :]) & 1).astype(bool)
        self.raw = [r["sketch"] for r in rows]
        self.widths = np.array([len(s) for s in self.raw])
        self.folded: dict[int, np.ndarray] = {}

    def _sketches(self, width: int) -> np.ndarray:
        """All sketches of at least ``width`` bytes, folded to that width; rows of shorter ones stay empty."""
        if width not in self.folded:
            out = np.zeros((len(self.raw), width // 8), dtype=np.uint64)
            for i, raw in enumerate(self.raw):
                if len(raw) >= width:
                    out[i] = np.bitwise_xor.reduce(np.frombuffer(raw, dtype=np.uint64).reshape(-1, width // 8), axis=0)
            self.folded[width] = out
        return self.folded[width]

    def pairs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, partner rows, sketch distance in shingles of both) for all that can be linked and are not taken up elsewhere."""
        split = self.split
        for i in np.flatnonzero(~self.right) if split else range(len(self.nodes) - 1):
            j = np.flatnonzero(self.right) if split else np.arange(i + 1, len(self.nodes))
            small, large = np.minimum(self.sizes[i], self.sizes[j]), np.maximum(self.sizes[i], self.sizes[j])
            j = j[small * 100 >= large * self.percent]
            same = self.values[j] == self.values[i]
            good = same.sum(axis=1) >= self.least
            if self.coordinate:
                c = self.coordinate
                good &= ~(same[:, :c] & self.earlier[j] & self.earlier[i]).any(axis=1)
            j = j[good]
            if not len(j):
                continue
            distance = np.zeros(len(j), dtype=np.int64)
            width = np.minimum(self.widths[j], self.widths[i])
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                matrix = self._sketches(int(w))
                distance[at] = np.bitwise_count(matrix[j[at]] ^ matrix[i]).sum(axis=1)
            both = self.sizes[i] + self.sizes[j]
            near = distance * (100 + self.percent) <= both * (100 - self.percent)
            if near.any():
                yield int(i), j[near], distance[near] / both[near]

    def forest(self) -> list[tuple[int, int]]:
        """A spanning forest of the pairs, nearest first."""
        edges = [(d, i, int(j)) for i, js, ds in self.pairs() for j, d in zip(js, ds.tolist())]
        parent = list(range(len(self.nodes)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for _, i, j in sorted(edges):
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                out.append((self.nodes[i], self.nodes[j]))
        return out

    def between(self, roots: list[int]) -> list[tuple[int, int]]:
        """All pairs between different components."""
        top = np.array(roots)
        return [(self.nodes[i], self.nodes[int(j)]) for i, js, _ in self.pairs() for j in js[top[js] != top[i]]]


def _candidates(posted: DataFrame, percent: int, least: int, choose: Callable[[_Unit, list[dict]], list[tuple[int, int]]]) -> DataFrame:
    """(a, b, key, i, j): the pairs that ``choose`` takes from each unit of work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit: list[dict] = []
        out: list[tuple] = []

        def close() -> None:
            if len(unit) > 1:
                key = (unit[0]["key"], unit[0]["i"], unit[0]["j"])
                out.extend((*sorted(p), *key) for p in choose(_Unit(key[0], unit, percent, least), unit))
            unit.clear()

        def taken() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["a", "b", "key", "i", "j"])
            out.clear()
            return batch

        for batch in batches:
            for row in batch.to_pylist():
                if unit and (row["key"], row["i"], row["j"]) != (unit[0]["key"], unit[0]["i"], unit[0]["j"]):
                    close()
                unit.append(row)
            if len(out) > 10_000:
                yield taken()
        close()
        if out:
            yield taken()

    dealt = posted.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint, key bigint, i int, j int")


def _sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, shingles): the full sets of some classes, made again from the text of one of their documents."""
    wanted = nodes.join(classes.select("node", "first.*", "d1", "d2"), "node")
    texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    met = texts.join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = [], []
            digests = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            for node, text, digest in zip(batch.column(0).to_pylist(), text_bytes(batch, "text"), digests):
                found = shingle_set(text, size)
                if len(found) and set_digest(found) == digest:  # another text may have the same hash
                    ids.append(node)
                    sets.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])

    return met.select("node", "d1", "d2", "text").mapInArrow(run, "node bigint, shingles binary")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``pairs`` with ``linked``: whether the full sets are similar enough."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = stage(_sets_of(nodes, classes, docs, size), "sets")
    if sets.count() > sets.select("node").distinct().count():  # a row that is there twice
        sets = stage(sets.dropDuplicates(["node"]), "sets")
    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"set_{name}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")

    def build(batch: pa.RecordBatch) -> dict:
        out = []
        for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
            left, right = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            common = len(np.intersect1d(left, right, assume_unique=True))
            out.append(100 * common >= percent * (len(left) + len(right) - common))
        return {"linked": out}

    return map_batches(met, build, "linked boolean", pairs.columns)


_NAME = "struct(doc_id IS NULL AS unnamed, doc_id, text_hash)"


def similar_classes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The prints of all documents, the classes of equal sets (node, d1, d2, first, ...), and (node, root) of the linked classes.

    ``first`` names a row of the class: the smallest doc_id, null after all others, and of rows with that one the smallest hash of the text.
    """
    made = stage(prints(docs, size), "prints")
    classes = made.where("n_shingles > 0").groupBy("d1", "d2").agg(
        F.min(F.expr(_NAME)).alias("first"), F.first("n_shingles").alias("n_shingles"),
        F.first("signature").alias("signature"), F.first("sketch").alias("sketch"),
    )
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    least = least_matches(percent)
    posted = stage(_posted(classes, least), "posted")
    tested = stage(_confirmed(stage(_candidates(posted, percent, least, lambda unit, _: unit.forest()), "forest"), classes, docs, size, percent), "tested")
    found = connected(tested.where("linked"))
    failed = tested.where("NOT linked").select("key", "i", "j").distinct()
    open_units = posted.join(failed, ["key", "i", "j"], "left_semi")
    labelled = open_units.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = _candidates(labelled, percent, least, lambda unit, rows: unit.between([r["root"] for r in rows]))
    rest = rest.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    rest = stage(rest, "between")
    if not rest.isEmpty():
        more = stage(_confirmed(rest, classes, docs, size, percent), "tested").where("linked")
        found = connected(tested.where("linked").select("a", "b").unionByName(more.select("a", "b")))
    return made, classes, found


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash, stands; one row per document.

    Documents are linked if 100 * intersection >= percent * union of their sets of ``size``-word shingles. ``stands`` marks the
    rows of each group with one doc_id and one text, known by ``text_hash``: to keep these alone keeps one document of every group.
    Rows without words are no group; all of them stand.
    """
    made, classes, found = similar_classes(docs, size, percent)
    member = classes.select("d1", "d2", "node", "first").join(found, "node", "left")
    smallest = member.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("least"))
    named = member.join(smallest, "root", "left").select("d1", "d2", F.coalesce("least", "first").alias("first"))
    met = made.select("doc_id", "n_shingles", "text_hash", "d1", "d2").join(named, ["d1", "d2"], "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    stands = alone | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
    return met.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", stands.alias("stands")
    )
