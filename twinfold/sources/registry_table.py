"""The registry as a table of buckets by digest, and the alert log as a table of days.

A file's bucket follows from its digest. So a batch of new files meets the registry without a move of the registry, and a
digest is looked up in one bucket. Alerts of a span of days are read from the folders of these days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.operators.exact import with_original
from twinfold.schemas import ALERTS, DOWNLOADS
from twinfold.session import Keep, stage

#: Buckets of a registry; a bucket should stay within what a task sorts in memory.
BUCKETS = 1024


def _names(columns: str) -> list[str]:
    return [part.split()[0] for part in columns.split(", ")]


def _at(location: str | None) -> str:
    return f" LOCATION '{location}'" if location else ""


def create_registry(spark: SparkSession, table: str, buckets: int = BUCKETS, location: str | None = None) -> None:
    """An empty registry where there is none; safe to repeat. ``location`` is a folder other than the warehouse's."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({DOWNLOADS}) USING parquet "
        f"CLUSTERED BY (file_hash) SORTED BY (file_hash) INTO {int(buckets)} BUCKETS{_at(location)}"
    )


def create_alerts(spark: SparkSession, table: str, location: str | None = None) -> None:
    """An empty alert log by ``created_date`` where there is none; safe to repeat."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({ALERTS}, created_date DATE) USING parquet PARTITIONED BY (created_date){_at(location)}")


def _buckets(spark: SparkSession, table: str) -> int:
    return int(spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first().data_type)


def add_files(files: DataFrame, table: str) -> None:
    """Append registry rows, one file a bucket."""
    spread = files.select(*_names(DOWNLOADS)).repartition(_buckets(files.sparkSession, table), "file_hash")
    spread.write.insertInto(table)


def insert_new(new: DataFrame, table: str, keep: Keep = stage) -> DataFrame:
    """Add the first of ``new``'s files with each digest that the registry does not hold; returns the verdicts of all.

    ``new`` has the columns of the registry. Only the digests of new files move; run again after it has succeeded it adds nothing.
    """
    registry = new.sparkSession.table(table)
    verdicts = keep(with_original(new, registry, keep), "verdicts")
    add_files(new.join(verdicts.where("accepted").select("id"), "id", "left_semi"), table)
    return verdicts


def add_alerts(alerts: DataFrame, table: str) -> None:
    """Append alert rows to their days."""
    alerts.select(*_names(ALERTS), F.to_date("created_time").alias("created_date")).write.insertInto(table)


def alerts_between(spark: SparkSession, table: str, start: str, end: str) -> DataFrame:
    """Alerts created in [start, end), read from the days in question."""
    time, day = F.col("created_time"), F.col("created_date")
    first, last = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
    days = (day >= F.to_date(first)) & (day <= F.to_date(last))
    return spark.table(table).where(days & (time >= first) & (time < last)).drop("created_date")
