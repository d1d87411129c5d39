"""Joins with hot keys: same rows as a plain join, in bounded groups."""

import random

import pytest
from pyspark.sql import functions as F

from twinfold.operators import skew


def _rows(spark, n=400, seed=3):
    """A third of all rows share one key."""
    rng = random.Random(seed)
    return spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}") for i in range(n)], "id long, key string")


def test_lookup_join(spark, monkeypatch):
    rows = _rows(spark)
    table = rows.groupBy("key").agg(F.count("*").alias("held"), F.min("id").alias("first"))
    plain = sorted(map(tuple, rows.join(table, "key").select("id", "key", "first").collect()))
    for hot_keys in (1, 4, 1000):
        monkeypatch.setattr(skew, "HOT_KEYS", hot_keys)
        for largest in (None, 10**9):
            found = skew.lookup_join(rows, table, "key", "held", "id", largest)
            assert sorted(map(tuple, found.collect())) == plain
    assert sorted(map(tuple, skew.lookup_join(rows, table, "key", "held", "id", 200).collect())) == plain


def test_lookup_join_drops_what_the_table_lacks(spark):
    rows = _rows(spark)
    table = rows.where("key <> 'k1'").groupBy("key").agg(F.count("*").alias("held"))
    assert skew.lookup_join(rows, table, "key", "held", "id").where("key = 'k1'").count() == 0


@pytest.mark.parametrize("hot_keys", [1, 4, 1000])
def test_block_join(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(skew, "HOT_KEYS", hot_keys)
    a = _rows(spark).select("key", F.col("id").alias("a"))
    b = _rows(spark, 300, 5).select("key", F.col("id").alias("b"))
    want = sorted(map(tuple, a.join(b, "key").where("a < b").select("key", "a", "b").collect()))
    for block in (7, 50, 100_000):
        for largest in (None, 200):
            found = skew.block_join(a, b, ["key"], "a", "b", F.col("a") < F.col("b"), block, largest)
            assert sorted(map(tuple, found.select("key", "a", "b").collect())) == want


def test_no_group_of_a_block_join_is_large(spark):
    a, block = _rows(spark, 900), 20
    hot = skew._large_keys(a, ["key"], "l", block).select("key", F.col("_bl").alias("n"))
    assert hot.where("key = 'hot'").first()["n"] == 15
    sizes = a.join(hot, "key").groupBy("key", F.pmod(F.xxhash64("id"), F.col("n"))).count()
    assert sizes.agg(F.max("count")).first()[0] < 3 * block


def test_numbers_are_dense_and_in_order(spark):
    from twinfold.operators.numbering import numbered

    rows = spark.range(0, 500, numPartitions=7).select("id", F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"))
    found = numbered(rows, "v", "id", name="n", start=11).orderBy("n").collect()
    assert [r.n for r in found] == list(range(11, 511))
    assert [(r.v, r.id) for r in found] == sorted((r.v, r.id) for r in found)
