"""First sightings of digests, kept by Spark's state store: a batch learns what is known without reading a registry.

The state of a digest is the file that came first with it. It lives in RocksDB under the query's checkpoint, partitioned by digest, so the cost of
a batch goes with the batch; a restart finds it as it was.

Digests and alerts are dealt into ``BUCKETS``, and a processor takes a bucket at a time with a map from key to state: a batch calls a processor at
most so many times, works on frames of many keys, and reads and writes only the entries of its own keys.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Groups that keys are dealt into. State is kept under them, so the number holds for the life of a checkpoint.
BUCKETS = 1024

#: An entry of the state is a page of 2 ** PAGE_BITS alerts with neighbouring ids, which mostly come together.
PAGE_BITS = 6

#: Stands for a missing number in a frame, whose columns hold no null beside whole numbers; it sorts last.
NONE = (1 << 63) - 1

_FILE = "id bigint, file_name string, file_path string, downloaded_by string, at bigint"
_NAMES = [part.split()[0] for part in _FILE.split(", ")]


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need a provider with column families; the setting holds for queries that start after it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)


def _plain(value):
    """A cell as state and Arrow take it."""
    return None if value is None or value != value else value.item() if hasattr(value, "item") else value


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS))


def _number(value: Column) -> Column:
    return F.coalesce(value.cast("bigint"), F.lit(NONE))


def _or_null(name: str) -> Column:
    return F.when(F.col(name) != NONE, F.col(name))


class _FirstSeen(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._first = handle.getMapState("first", "digest string", _FILE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """The batch's files of one bucket of digests, in order of arrival; a batch bounds their number."""
        files = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable", ignore_index=True)
        leads = ~files.duplicated("digest")
        first, new = {}, set()
        for digest, *values in files.loc[leads, ["digest", *_NAMES]].itertuples(index=False, name=None):
            known = self._first.getValue((digest,))
            if known is None:
                known = tuple(_plain(v) for v in values)
                self._first.updateValue((digest,), known)
                new.add(digest)
            first[digest] = known
        for i, name in enumerate(_NAMES):
            files[f"first_{name}"] = [first[d][i] for d in files["digest"]]
        files["accepted"] = leads & files["digest"].isin(new)
        yield files.drop(columns="bucket", errors="ignore")

    def close(self) -> None:
        pass


def with_first(files: DataFrame) -> DataFrame:
    """The files of a stream with ``original``, the file that came first with their digest, and ``accepted``, true for that file itself.

    ``files``: (id, file_name, file_path, downloaded_by, download_time, file_hash). Within a batch the earliest by (download_time, id) is first;
    across batches the earlier batch. Only narrow rows move, by digest.
    """
    use_state_store(files.sparkSession)
    at = _number(F.unix_micros(F.col("download_time").cast("timestamp"))).alias("at")
    digest = F.coalesce("file_hash", F.lit(""))  # no digest is empty
    narrow = files.select(digest.alias("digest"), _number(F.col("id")).alias("id"), "file_name", "file_path", "downloaded_by", at)
    kinds = dict(part.split() for part in _FILE.split(", "))
    schema = ", ".join(["digest string", _FILE, *[f"first_{c} {kind}" for c, kind in kinds.items()], "accepted boolean"])
    found = narrow.withColumn("bucket", _bucket(F.col("digest"))).groupBy("bucket").transformWithStateInPandas(_FirstSeen(), schema, "Append", "None")
    time = lambda c: F.timestamp_micros(_or_null(c)).cast("timestamp_ntz").alias("download_time")
    own = lambda c: (_or_null(c) if c.endswith("id") else F.col(c))
    first = [own(f"first_{c}").alias(c) for c in _NAMES if c != "at"]
    return found.select(
        F.nullif("digest", F.lit("")).alias("file_hash"), *[own(c).alias(c) for c in _NAMES[:-1]], time("at"),
        F.struct(*first, time("first_at")).alias("original"), "accepted",
    )


class _AlertTally(StatefulProcessor):
    """What the alerts of a bucket and their status changes add to the counts, as they become known."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._pages = handle.getMapState("page", "page string", "alerts string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        alerts = pending = 0
        for frame in rows:
            for page, mine in frame.groupby("page", sort=False):
                known = self._pages.getValue((page,))
                states = json.loads(known[0]) if known else {}
                change = self._change(states, mine)
                alerts, pending = alerts + change[0], pending + change[1]
                self._pages.updateValue((page,), (json.dumps(states),))
        yield pd.DataFrame({"alerts": [alerts], "pending": [pending]})

    def _change(self, states: dict[str, list], rows: pd.DataFrame) -> tuple[int, int]:
        """Bring the ``states`` (seen, at, seq, status) of a page's alerts up to date; what that adds to the counts."""
        alerts = pending = 0
        for alert, is_alert, *change in rows[["alert", "is_alert", "at", "seq", "status"]].itertuples(index=False, name=None):
            seen, *last = states.get(alert, (False, None, None, None))
            before = self._counts(seen, last[2])
            change = [_plain(v) for v in change]
            if is_alert:
                seen = True
            elif last[0] is None or change > last:  # the latest change counts, whenever it comes
                last = change
            states[alert] = [seen, *last]
            now = self._counts(seen, last[2])
            alerts, pending = alerts + now[0] - before[0], pending + now[1] - before[1]
        return alerts, pending

    @staticmethod
    def _counts(seen: bool, status: str | None) -> tuple[int, int]:
        return int(seen), int(seen and status in (None, "pending"))

    def close(self) -> None:
        pass


def alert_tally(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """(alerts, pending): signed rows of what a batch changes in the counts.

    ``alerts`` (id) and ``changes`` (alert_id, ts, seq, status) are streams. A status change may come before its alert, or out of order;
    rows that come twice change nothing.
    """
    use_state_store(alerts.sparkSession)
    # a frame's columns of whole numbers hold no null: alerts have 0 there, which nothing reads
    zero = lambda name: F.lit(0).cast("bigint").alias(name)
    new = alerts.select(F.col("id").alias("alert_id"), F.lit(True).alias("is_alert"), zero("at"), zero("seq"), F.lit(None).cast("string").alias("status"))
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    changed = changes.select("alert_id", F.lit(False).alias("is_alert"), at, "seq", "status")
    text = lambda value: F.coalesce(value.cast("string"), F.lit(""))
    rows = new.unionByName(changed).withColumns({"alert": text(F.col("alert_id")), "page": text(F.shiftright("alert_id", PAGE_BITS))}).drop("alert_id")
    counted = rows.withColumn("bucket", _bucket(F.col("page"))).groupBy("bucket").transformWithStateInPandas(_AlertTally(), "alerts bigint, pending bigint", "Append", "None")
    return counted.select("alerts", "pending")
