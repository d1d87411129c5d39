"""Clustering of vectors around centroids in exact integers, with a distance matrix that is kept and amended.

Every vector carries its dot products with all centroids. When centroids move, a product changes only by the vector's components at the places
where that centroid changed, times the change: d + sum of v[i] * (new[i] - old[i]) over the changed i. The squared distance to a centroid
is |v|^2 - 2 d + |c|^2, so the nearest one follows from the products alone. Vectors, products and clusters are written after each round, and
the round before is deleted; a lost executor re-reads. The driver holds the centroids and one sum per cluster and component.

All numbers are integers: a component x becomes floor(1024 * x). Up to ``LARGEST`` in size they give distances that fit 64 bits, and larger
ones raise an error; sums over vectors are decimal and do not overflow.

Defined results: vectors that are null, have another number of components, or hold a null or a value that is not finite are left out. Rows
with equal vec_id are vectors of their own; of equal hashes the smaller vector comes first as a start. With fewer vectors than centroids
there are as many centroids as vectors, and from an empty table nothing comes. A null vec_id is hashed as the empty text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import extended
from twinfold.session import Held

SIZE, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3

#: With 64 components of at most this size a squared distance stays below 2^61.
LARGEST = 1 << 26


def quantised(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and ``v``, the integer components of every vector that is whole."""
    x = F.col("embedding")
    good = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf")))
    whole = vectors.where((F.size(x) == size) & F.forall(x, good))
    floor = lambda e: F.floor(F.lit(float(scale)) * e.cast("double"))  # saturates where no long holds it, which ``_checked`` finds
    return whole.select("vec_id", F.transform(x, floor).alias("v"))


def starts(vectors: DataFrame, count: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The ``count`` vectors whose ids have the smallest hash, in the order of the hashes."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in vectors.select(digest.alias("h"), "v").orderBy("h", "v").limit(count).collect()]


def amended(products: np.ndarray, vectors: np.ndarray, changes: list[np.ndarray]) -> np.ndarray:
    """The dot products after each centroid moved by its row of ``changes``: only changed components are multiplied."""
    out = products.copy()
    for number, change in enumerate(changes):
        places = np.flatnonzero(change)
        if len(places):
            out[:, number] += vectors[:, places] @ change[places]
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(column) else np.zeros((0, width), dtype=np.int64)


def _round(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """``state`` after the centroids went from ``old`` to ``new``."""
    changes, lengths, (count, width) = list(new - old), (new * new).sum(axis=1), new.shape
    first = "products" not in state.columns
    out = extended(state, ["vec_id"], "v array<int>, products array<bigint>, cluster int, distance bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            vectors = _matrix(column("v"), width).astype(np.int64)
            before = np.zeros((len(vectors), count), dtype=np.int64) if first else _matrix(column("products"), count)
            products = amended(before, vectors, changes)
            distances = (vectors * vectors).sum(axis=1)[:, None] - 2 * products + lengths
            nearest = distances.argmin(axis=1)  # of equal distances the smaller number
            lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
            columns = [column("vec_id"), lists(vectors), lists(products), pa.array(nearest), pa.array(distances[np.arange(len(vectors)), nearest])]
            yield pa.RecordBatch.from_arrays([c.cast(target.field(i).type) for i, c in enumerate(columns)], schema=target)

    return state.mapInArrow(run, out)


def _sums(state: DataFrame, count: int, width: int) -> tuple[np.ndarray, list[list[int]]]:
    """Vectors in each cluster, and their exact sums; added up by batch before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, cluster = _matrix(batch.column(0), width).astype(np.int64), batch.column(1).to_numpy()
            for number in np.unique(cluster):
                mine = vectors[cluster == number]
                sums = pa.ListArray.from_arrays(pa.array([0, width], pa.int32()), pa.array(mine.sum(axis=0)))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([len(mine)], pa.int64()), sums], ["cluster", "n", "sums"])

    parts = state.select("v", "cluster").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    total = lambda i: F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}")
    sizes, sums = np.zeros(count, dtype=np.int64), [[0] * width for _ in range(count)]
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[total(i) for i in range(width)]).collect():  # a row per centroid
        sizes[row["cluster"]] = row["n"]
        sums[row["cluster"]] = [int(row[f"s{i}"]) for i in range(width)]
    return sizes, sums


def _moved(centroids: np.ndarray, sizes: np.ndarray, sums: list[list[int]]) -> np.ndarray:
    """Each centroid at the floor of its mean; one without vectors stays."""
    moved = [[s // int(n) for s in own] if n else list(c) for c, n, own in zip(centroids, sizes, sums)]
    return np.array(moved, dtype=np.int64).reshape(centroids.shape)


def _checked(vectors: DataFrame) -> bool:
    """Whether there are vectors; raises where a component is too large for exact distances in 64 bits."""
    top, low = vectors.agg(F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    if top is not None and (top > LARGEST or low < -LARGEST):
        raise ValueError(f"components beyond {LARGEST} in size have no exact distances in 64 bits")
    return top is not None


def clustered(
    vectors: DataFrame, size: int = SIZE, scale: int = SCALE, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, products, cluster, distance) of every whole vector after ``rounds`` moves, and the centroids.

    ``vectors`` has vec_id and embedding. When no centroid moves, further rounds would change nothing and are left out.
    """
    held = Held(vectors.sparkSession)
    state = held(quantised(vectors.select("vec_id", "embedding"), size, scale), "vectors")
    new = np.array(starts(state, count, seed) if _checked(state) else [], dtype=np.int64).reshape(-1, size)
    old = np.zeros_like(new)
    for step in range(rounds + 1):
        keep = Held(vectors.sparkSession)
        state = keep(_round(state, old, new), "clusters")
        held.release()
        held = keep
        if step == rounds:
            break
        old, new = new, _moved(new, *_sums(state, len(new), size))
        if (old == new).all():
            break
    return state, new


def report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    state, centroids = clustered(vectors, **options)
    inertia = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(inertia.values())
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    pick = lambda values, kind: F.get(F.array(*[F.lit(x) for x in values]), F.col("cluster")).cast(kind) if values else F.lit(None).cast(kind)
    return state.select(
        "vec_id", "cluster", "distance", pick([inertia.get(i, 0) for i in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(total).cast("bigint").alias("inertia"), pick([digest(c) for c in centroids], "string").alias("centroid_sha256"),
    )
