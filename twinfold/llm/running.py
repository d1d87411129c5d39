"""Running sums within groups of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinfold.session import stage


def sums_before(rows: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows of the same group that stand before, by ``order``.

    Rows are dealt by range of (group, order), so that a large group spans many partitions. Each partition sums its own
    part, and one row per partition and group carries what stands before it. ``order`` has to tell all rows apart, or
    rows that agree in it may change places.
    """
    dealt = rows.repartitionByRange(F.col(group), *[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id())
    dealt = stage(dealt, "ranges")
    parts = dealt.groupBy("_part", group).agg(F.sum(value).alias("_sum"))
    earlier = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        F.col("_part").alias("_of"), F.col(group).alias("_group"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset")
    )
    own = W.partitionBy("_part", group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = dealt.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    met = summed.join(offsets, (F.col("_part") == F.col("_of")) & F.col(group).eqNullSafe(F.col("_group")))
    return met.withColumn(name, F.col("_offset") + F.col("_own")).drop("_part", "_own", "_of", "_group", "_offset")
