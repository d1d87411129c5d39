"""What a running detector tells its users: the alert feed and the refreshing statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from twinfold.operators.alerts import alerts_pending, current_status, stats, status_change
from twinfold.session import stage
from twinfold.streaming.first_seen import alert_tally
from twinfold.streaming.store import Store


def _now() -> Column:
    return F.now().cast("timestamp_ntz")


def _trigger(every: str | None) -> dict:
    return {"processingTime": every} if every else {"availableNow": True}


def alert_feed(
    store: Store, user: str, deliver: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Hand each pending alert of ``user`` to ``deliver`` once and mark it shown.

    The checkpoint remembers what was seen, also while nothing was running. An alert that has a status change
    already is not handed out again, which covers a batch of the monitor that was written twice.
    """
    writer = f"feed-{user}"

    def show(rows: DataFrame, batch: int) -> None:
        log = store.read("status_log", writer, before=batch)
        mine = stage(rows.where(F.col("alert_for") == user).dropDuplicates(["id"]), "delivered")
        log = log.join(mine.select(F.col("id").alias("alert_id")), "alert_id", "left_semi")
        pending = stage(alerts_pending(current_status(mine, log), user), "pending")
        deliver(pending.orderBy("id"), batch)
        store.write(status_change(pending, "shown", _now(), F.lit(batch)), "status_log", writer, batch)

    return (
        store.follow("alerts").writeStream.foreachBatch(show).option("checkpointLocation", checkpoint)
        .queryName(f"alerts for {user}").trigger(**_trigger(every)).start()
    )


def resolve(store: Store, alert_ids: DataFrame, request: int, by: str = "dashboard") -> None:
    """Mark alerts (id) resolved. ``request`` numbers the call: the same one again replaces itself."""
    store.write(status_change(alert_ids, "resolved", _now(), F.lit(request)), "status_log", by, request)


def current_stats(store: Store) -> DataFrame:
    alerts = current_status(store.read("alerts"), store.read("status_log"))
    return stats(store.read("downloads"), alerts)


def stats_feed(
    store: Store, deliver: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Hand the statistics to ``deliver`` whenever the registry, the alerts or their status have changed.

    A batch reads its own rows only: the state store knows each alert's status and says what its changes add, and the totals are those of the
    batch before and that.
    """
    number = lambda value: F.lit(value).cast("bigint")
    files = store.follow("downloads").select(number(1).alias("files"), number(0).alias("alerts"), number(0).alias("pending"))
    tally = alert_tally(store.follow("alerts").select("id"), store.follow("status_log"))
    merged = files.unionByName(tally.select(number(0).alias("files"), "alerts", "pending"))
    writer = f"statistics-{hashlib.md5(checkpoint.encode()).hexdigest()[:12]}"
    names = ["files", "alerts", "pending"]

    def show(rows: DataFrame, batch: int) -> None:
        if batch:
            rows = rows.unionByName(store.spark.read.parquet(store.path("totals", writer, batch - 1)).select(*names))
        totals = store.write(rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]), "totals", writer, batch)
        deliver(totals.select(F.col("files").alias("total_files"), F.col("alerts").alias("total_alerts"), "pending"), batch)

    return (
        merged.writeStream.foreachBatch(show).option("checkpointLocation", checkpoint).queryName("statistics").trigger(**_trigger(every)).start()
    )
