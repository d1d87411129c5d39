"""The registry in buckets and alerts by day."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from twinfold.operators.exact import find_by_hash, originals
from twinfold.schemas import ALERTS, DOWNLOADS
from twinfold.sources import registry_table as rt


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _files(spark, ids, salt=""):
    row = lambda i: (i, f"f{i}.txt", f"{i % 40}{salt}", f"/f{i}.txt", "txt", 10, "words", None, None, "ann", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i))
    return spark.createDataFrame([row(i) for i in ids], DOWNLOADS)


@pytest.fixture
def registry(spark, tmp_path):
    name = "twinfold_test_registry"
    rt.create_registry(spark, name, 8, str(tmp_path / "registry"))
    rt.create_registry(spark, name, 8, str(tmp_path / "registry"))
    yield name
    spark.sql(f"DROP TABLE {name}")


def test_insert_if_new(spark, registry):
    first = rt.insert_new(_files(spark, range(0, 30)), registry)
    assert first.where("accepted").count() == 30
    for _ in range(2):  # a second run adds nothing
        again = rt.insert_new(_files(spark, range(30, 100)), registry)
        held = {r.file_hash: r.id for r in spark.table(registry).collect()}
        assert len(held) == spark.table(registry).count() == 40
        assert held == {str(h): h for h in range(40)}
    assert again.where("accepted").count() == 0
    assert {r.original.id for r in again.where("id = 70").collect()} == {30}


def test_a_digest_is_read_from_one_bucket(spark, registry):
    rt.add_files(_files(spark, range(40)), registry)
    found = find_by_hash(spark.table(registry), "7")
    assert [r.id for r in found.collect()] == [7]
    assert found.rdd.getNumPartitions() == 1 < spark.table(registry).rdd.getNumPartitions()
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # otherwise the plan does not name the buckets
    try:
        assert "SelectedBucketsCount: 1 out of 8" in _plan(find_by_hash(spark.table(registry), "7"))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_the_registry_does_not_move(spark, registry):
    rt.add_files(_files(spark, range(40)), registry)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = _plan(originals(_files(spark, range(100, 160)), spark.table(registry))).split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and registry in line)
    join = max(i for i, line in enumerate(lines[:scan]) if "Join" in line)
    assert "Bucketed: true" in lines[scan]
    assert not [line for line in lines[join:scan] if "Exchange" in line]


def test_alerts_of_a_span_come_from_their_days(spark, tmp_path):
    table = "twinfold_test_alerts"
    rt.create_alerts(spark, table, str(tmp_path / "alerts"))
    try:
        time = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * i)
        rows = [(i, "ann", "exact", 1.0, "a", "/a", "b", "/b", "bob", None, 1, time(i) if i else None) for i in range(60)]
        rt.add_alerts(spark.createDataFrame(rows, ALERTS), table)
        start, end = "2024-01-03", "2024-01-05 12:00:00"
        found = rt.alerts_between(spark, table, start, end)
        low, high = dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 5, 12)
        assert sorted(r.id for r in found.collect()) == [i for i in range(1, 60) if low <= time(i) < high]
        assert "created_date" in _plan(found).split("PartitionFilters: ")[1].split("PushedFilters")[0]
        assert spark.table(table).where(F.col("id") == 0).count() == 1
    finally:
        spark.sql(f"DROP TABLE {table}")
