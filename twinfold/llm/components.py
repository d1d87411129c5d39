"""Connected components of a graph given as links, by alternating stars.

Each round hangs every node below the smallest neighbour it knows (large star) and then its neighbours below the smallest of them (small star);
the number of rounds grows with the logarithm of the longest path. Every round is written, and the driver sees only a row count and
a checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.session import stage


def _contracted(links: DataFrame) -> DataFrame:
    """The links of each partition as stars around the smallest node of each of their components: fewer and shorter links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        stars = [(x, root(x)) for x in list(parent)]
        stars = [s for s in stars if s[0] != s[1]]
        if stars:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*stars)], ["u", "v"])

    return links.select("a", "b").mapInArrow(run, "u bigint, v bigint")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    met = down.join(least, "u")
    return met.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select(
        F.col("e.u").alias("u"), F.col("e.m").alias("v")
    ).where("u > v").distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b bigint); root is the smallest node of its component, which is in the result too."""
    edges = stage(_contracted(links), "stars")
    seen = None
    while True:
        edges = stage(_small_star(_large_star(edges)), "stars")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
