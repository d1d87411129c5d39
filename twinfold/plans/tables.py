"""Queries over tables of the session's catalog: the registry in buckets, alerts by day.

Their data lie in the folder for intermediate data, not in the warehouse.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.operators.exact import find_by_hash
from twinfold.operators.registry import first_sightings
from twinfold.plans import views as v
from twinfold.session import stage_root
from twinfold.sources import registry_table as rt

#: Buckets of the tables of these queries.
BUCKETS = 16

_registries: dict[tuple[str, str], str] = {}


def _new(spark: SparkSession, kind: str) -> tuple[str, str]:
    """A name of its own and a folder."""
    name = f"twinfold_{kind}_{uuid.uuid4().hex}"
    return name, f"{stage_root(spark)}/{spark.sparkContext.applicationId}/{name}"


def registry(spark: SparkSession, sf_dir: str) -> str:
    """The table after the earlier files were there and the later ones have come; built once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _registries:
        table, location = _new(spark, "registry")
        new, earlier = v.arrivals(spark, sf_dir)
        rt.create_registry(spark, table, BUCKETS, location)
        rt.add_files(v.registered(first_sightings(earlier)), table)
        rt.insert_new(v.registered(new), table)
        _registries[key] = table
    return _registries[key]


def registry_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(registry(spark, sf_dir)).select(
        "id", "file_name", "file_hash", "file_size", "downloaded_by", F.md5("extracted_text").alias("text_digest")
    )


def find_by_hash_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.table(registry(spark, sf_dir))
    digest = table.agg(F.min("file_hash")).first()[0]
    return find_by_hash(table, digest).select("id", "file_name", "file_hash", "file_path", "downloaded_by")


def alerts_by_day(spark: SparkSession, sf_dir: str, start: str, end: str) -> DataFrame:
    table, location = _new(spark, "alerts")
    rt.create_alerts(spark, table, location)
    rt.add_alerts(v.alert_log(spark, sf_dir), table)
    return rt.alerts_between(spark, table, start, end).select("id", "alert_for", "duplicate_type", "similarity", "new_file_name", "created_time")
