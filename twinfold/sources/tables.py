"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A split may hold this many times the rows that a core would get if they were dealt evenly.
UNEVEN = 2


def read_table(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Read a Parquet table; with ``key``, spread a table over the cores that is not spread over its splits.

    A row group is read by one task however many splits its bytes make: the others find no rows. So the rows of each split are
    counted, by ``key`` alone. A table with enough splits that hold about the same is left as it is, without a shuffle.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if key is None:
        return df
    splits = df.rdd.getNumPartitions()
    if splits < cores or _uneven(df.select(key), cores):
        return df.repartition(max(splits, cores), key)
    return df


def _uneven(df: DataFrame, cores: int) -> bool:
    held = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
    largest, total = held.agg(F.max("n"), F.sum("n")).first()
    return total is not None and largest * cores > UNEVEN * total
