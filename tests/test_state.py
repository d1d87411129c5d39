"""State kept by Spark between batches: first sightings and alert counts."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinfold.operators.alerts import current_status, stats
from twinfold.operators.exact import exact_alerts, exact_dup_alerts
from twinfold.streaming.feeds import stats_feed
from twinfold.streaming.first_seen import BUCKETS, _AlertTally, _FirstSeen, with_first
from twinfold.streaming.store import Store

FILES = "id long, file_name string, file_path string, downloaded_by string, download_time timestamp_ntz, file_hash string"
CHANGES = "alert_id long, status string, ts timestamp_ntz, seq long"


def _files(spark, seed, n):
    rng = random.Random(seed)
    rows = [(i, f"f{i}.txt", f"/srv/f{i}.txt", rng.choice(["ann", "bob", None]), rng.choice(["hot", "hot", *(f"h{k}" for k in range(n // 2))])) for i in range(n)]
    frame = spark.createDataFrame(rows, "id long, file_name string, file_path string, downloaded_by string, file_hash string")
    return frame.withColumn("download_time", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).cast("timestamp_ntz"))


@pytest.mark.parametrize("batches", [1, 3])
def test_batches_with_a_restart_equal_one_pass(spark, tmp_path, batches):
    files = _files(spark, batches, 60)
    for part in range(batches):  # each run is a restart: only the checkpoint knows what came before
        files.where(F.floor(F.col("id") * batches / 60) == part).write.mode("append").parquet(str(tmp_path / "in"))
        stream = with_first(spark.readStream.schema(files.schema).parquet(str(tmp_path / "in")))
        sink = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        sink.trigger(availableNow=True).start().awaitTermination()
    verdicts = spark.read.parquet(str(tmp_path / "out"))
    got, want = exact_alerts(verdicts), exact_dup_alerts(files)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    assert verdicts.where("accepted").count() == files.select("file_hash").distinct().count()
    assert verdicts.count() == 60


def test_counts_follow_alerts_and_changes(spark, tmp_path):
    """Over several batches: changes before their alert, out of order, and twice."""
    store, figures = Store(spark, str(tmp_path / "store")), []
    store.create()
    downloads, alerts = (spark.createDataFrame([], store.schema(t)).schema for t in ("downloads", "alerts"))

    def write(table, schema, ids, batch):
        rows = spark.createDataFrame([(i,) for i in ids], "id long")
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name not in ("id", "writer", "batch")]
        store.write(rows.select("id", *empty), table, "w", batch)

    def change(rows, batch):
        table = spark.createDataFrame([(a, s, float(t), n) for a, s, t, n in rows], "alert_id long, status string, t double, seq long")
        store.write(table.select("alert_id", "status", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"), "seq"), "status_log", "w", batch)

    def run():
        stats_feed(store, lambda row, batch: figures.append(tuple(row.first())), str(tmp_path / "cp")).awaitTermination()
        status = current_status(store.read("alerts"), store.read("status_log"))
        assert figures[-1] == tuple(stats(store.read("downloads"), status).first())

    write("downloads", downloads, range(5), 0), write("alerts", alerts, range(4), 0)
    run()
    assert figures[-1] == (5, 4, 4)
    change([(0, "shown", 10, 1), (7, "resolved", 10, 2), (1, "resolved", 12, 3)], 1)
    run()
    assert figures[-1] == (5, 4, 2)
    write("alerts", alerts, [7, 8], 2), change([(1, "pending", 11, 4), (0, "pending", 13, 5), (2, "shown", 10, 6), (2, "shown", 10, 6)], 2)
    run()
    assert figures[-1] == (5, 6, 3)
    count = len(figures)
    stats_feed(store, lambda row, batch: figures.append(tuple(row.first())), str(tmp_path / "cp")).awaitTermination()
    assert len(figures) == count  # nothing new, nothing handed out


class _Handle:
    """A state store of one bucket that counts how often it is asked."""

    def __init__(self):
        self.entries, self.asked = {}, 0

    def getMapState(self, *schema):
        return self

    def getValue(self, key):
        self.asked += 1
        return self.entries.get(key)

    def updateValue(self, key, value):
        self.entries[key] = value


def test_one_call_takes_many_digests():
    handle, first = _Handle(), _FirstSeen()
    first.init(handle)
    files = pd.DataFrame([(f"d{i % 50}", i, f"f{i}", f"/srv/f{i}", None, 100 - i) for i in range(100)], columns=["digest", "id", "file_name", "file_path", "downloaded_by", "at"])
    (out,) = first.handleInputRows((0,), iter([files[:60], files[60:]]), None)
    assert handle.asked == 50 and len(out) == 100
    accepted = out[out["accepted"]]
    assert sorted(accepted["id"]) == list(range(50, 100)) and (accepted["first_id"] == accepted["id"]).all()
    (again,) = first.handleInputRows((0,), iter([files]), None)
    assert not again["accepted"].any() and (again["first_id"] >= 50).all()


def test_one_call_takes_many_alerts():
    handle, tally = _Handle(), _AlertTally()
    tally.init(handle)
    alerts = [("0", str(i), True, 0, 0, None) for i in range(40)]
    changes = [("0", str(i), False, 10 + t, t, status) for i in range(30) for t, status in ((1, "resolved"), (0, "shown"))]
    rows = pd.DataFrame(alerts + changes, columns=["page", "alert", "is_alert", "at", "seq", "status"])
    (out,) = tally.handleInputRows((0,), iter([rows]), None)
    assert out.values.tolist() == [[40, 10]] and handle.asked == 1
    assert json.loads(handle.entries[("0",)][0])["0"] == [True, 11, 1, "resolved"]


def test_missing_digests_ids_and_times(spark, tmp_path):
    """Keys of every bucket's worth and rows without a digest, an id or a time; numbers stay whole beside them."""
    big = (1 << 60) + 1
    rows = [(big + i, f"f{i}", f"/f{i}", "ann", None if i == 3 else float(i), f"h{i}") for i in range(BUCKETS // 8)]
    rows += [(None, "n1", "/n1", None, None, None), (7, "n2", "/n2", None, 5.0, None), (big + 999, "n3", "/n3", "bob", 9_999.0, "h3")]
    files = spark.createDataFrame(rows, "id long, file_name string, file_path string, downloaded_by string, t double, file_hash string")
    files = files.withColumn("download_time", F.timestamp_seconds("t").cast("timestamp_ntz")).drop("t")
    files.write.parquet(str(tmp_path / "in"))
    stream = with_first(spark.readStream.schema(files.schema).parquet(str(tmp_path / "in")))
    sink = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    sink.trigger(availableNow=True).start().awaitTermination()
    found = {r.file_name: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(found) == len(rows) and found["f5"].id == big + 5 and found["f5"].accepted
    assert found["n2"].accepted and not found["n1"].accepted and found["n1"].id is None and found["n1"].download_time is None
    assert found["n1"].file_hash is None and found["n1"].original.file_name == "n2"
    assert found["n3"].accepted and found["f3"].original.id == big + 999 and found["f3"].download_time is None
