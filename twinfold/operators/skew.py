"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds at least 1/HOT_KEYS of all rows, so at most HOT_KEYS keys can be hot,
# however many rows there are. That is the size bound of the broadcast below.
HOT_KEYS = 1000

# Rows of one key that one task meets on each side of a block join.
BLOCK_ROWS = 20_000


def _attach(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str, total: Column, spread: str) -> DataFrame:
    """``rows`` with ``_row``: the struct of the ``table`` row of the same key, null where there is none.

    Keys that hold at least 1/HOT_KEYS of ``total`` are looked up in a broadcast of at most HOT_KEYS rows, all
    others meet by shuffle. Rows served by the broadcast go through that shuffle under a salt made from
    ``spread``, so that they land evenly.
    """
    payload = F.struct(*[c for c in table.columns if c not in keys])
    marked = table.withColumn("_hot", F.col(weight) * HOT_KEYS >= total)
    hot = marked.where("_hot").select(*[F.col(k).alias(f"_hot_{k}") for k in keys], payload.alias("_hot_row"))
    cold = marked.where("NOT _hot").select(
        *[F.col(k).alias(f"_cold_{k}") for k in keys], F.lit(0).alias("_cold_salt"), payload.alias("_cold_row")
    )
    same = lambda side: [F.col(k) == F.col(f"_{side}_{k}") for k in keys]
    salt = F.when(F.col("_hot_row").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int") + 1)
    served = rows.join(F.broadcast(hot), same("hot"), "left").withColumn("_salt", salt)
    met = served.join(cold, [*same("cold"), F.col("_salt") == F.col("_cold_salt")], "left")
    return met.select(*rows.columns, F.coalesce("_hot_row", "_cold_row").alias("_row"))


def lookup_join(
    rows: DataFrame, table: DataFrame, key: str, weight: str, spread: str, largest: int | None = None, keep_weight: bool = False
) -> DataFrame:
    """Inner join of many ``rows`` with a ``table`` that has one row per ``key``, balanced whatever the keys hold.

    ``weight`` is a column of ``table``: how many of ``rows`` carry the key. ``spread`` is a column of ``rows`` with
    many values. ``largest`` is the largest weight, where the caller knows it; a plain join does if that is small.
    ``keep_weight`` hands the weight through.
    """
    kept = [c for c in table.columns if c != key and (keep_weight or c != weight)]
    if largest is not None and largest <= BLOCK_ROWS:
        return rows.join(table.select(key, *kept), key).select(*rows.columns, *kept)
    joined = _attach(rows, table, [key], weight, table.agg(F.sum(weight)).scalar(), spread)
    return joined.where(F.col("_row").isNotNull()).select(*rows.columns, *[F.col(f"_row.{c}") for c in kept])


def largest_of(table: DataFrame, weight: str) -> int:
    """The largest weight of a staged table; one number."""
    return table.agg(F.max(weight)).first()[0] or 0


def _large_keys(rows: DataFrame, keys: Sequence[str], name: str, block_rows: int) -> DataFrame:
    return (
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_n{name}"))
        .where(F.col(f"_n{name}") > block_rows)
        .withColumn(f"_b{name}", F.ceil(F.col(f"_n{name}") / block_rows).cast("int"))
    )


def block_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: str,
    right_id: str,
    condition: Column,
    block_rows: int = BLOCK_ROWS,
    largest: int | None = None,
    grown: bool = False,
) -> DataFrame:
    """Equi-join on ``keys`` in which no task meets more than about ``block_rows`` rows of a key per side.

    A key with more rows is cut into blocks on each side and every left block is sent to every right
    block, so each pair of rows still meets exactly once. Columns of the two sides must differ but for
    ``keys``. ``largest`` is an upper bound of the rows per key and side, where the caller knows one. ``grown`` says that
    rows were exploded from small tables: Spark takes them to be as small as these and would send them through the driver, so both are shuffled.
    """
    keys = list(keys)
    dealt = lambda rows: rows.hint("merge") if grown else rows
    if largest is not None and largest <= block_rows:
        return dealt(left).join(dealt(right), keys).where(condition)
    large = _large_keys(left, keys, "l", block_rows).join(_large_keys(right, keys, "r", block_rows), keys, "full")
    large = large.select(*keys, *[F.coalesce(c, F.lit(1)).alias(c) for c in ("_nl", "_bl", "_nr", "_br")])

    def side(rows: DataFrame, me: str, id_column: str, own: str, other: str) -> DataFrame:
        theirs = "r" if me == "l" else "l"
        found = _attach(rows, large, keys, f"_n{me}", rows.agg(F.count(F.lit(1))).scalar(), id_column)
        blocks = lambda s: F.coalesce(F.col(f"_row._b{s}"), F.lit(1))
        mine = F.pmod(F.xxhash64(id_column), blocks(me)).cast("int")
        return found.select(*rows.columns, mine.alias(own), F.explode(F.sequence(F.lit(0), blocks(theirs) - 1)).alias(other))

    lhs, rhs = side(left, "l", left_id, "_i", "_j"), side(right, "r", right_id, "_j", "_i")
    return dealt(lhs).join(dealt(rhs), [*keys, "_i", "_j"]).where(condition).drop("_i", "_j")
