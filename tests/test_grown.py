"""Rows exploded from a small table are never sent through the driver, however small Spark takes them to be."""

import random

import pytest

from twinfold.operators import media as md
from twinfold.session import stage


@pytest.mark.parametrize("block", [20_000, 3])
def test_listed_neighbours_are_shuffled(spark, block):
    rng = random.Random(9)
    bits = list(dict.fromkeys(b ^ (1 << rng.randrange(63)) for b in (rng.getrandbits(62) for _ in range(30)) for _ in range(3)))
    codes = stage(spark.createDataFrame([(b,) for b in bits], "bits long"), "codes")
    pairs = md.code_pairs(codes, 4, block)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "value" in line and "LeftOuter" not in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    want = {(a, b, (a ^ b).bit_count()) for a in bits for b in bits if a < b and (a ^ b).bit_count() <= 4}
    assert {tuple(r) for r in pairs.collect()} == want
