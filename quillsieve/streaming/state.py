"""Expiring and retained rows, in batch and as streams."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def active_tokens(blacklist: DataFrame, now: Column) -> DataFrame:
    """The last row of each token, if it has not expired."""
    last = blacklist.groupBy("token").agg(F.max_by(F.struct("user_id", "expires_at", "reason"), "blacklisted_at").alias("r")).select("token", "r.*")
    return last.where(F.col("expires_at") >= now)


def blacklist_stats(blacklist: DataFrame, now: Column) -> DataFrame:
    last = blacklist.groupBy("token").agg(F.max_by("expires_at", "blacklisted_at").alias("expires_at"))
    active = F.count_if(F.col("expires_at") >= now)
    return last.agg(F.count("*").alias("total"), active.alias("active"), (F.count("*") - active).alias("expired"))


def retained(rows: DataFrame, now: Column, days: int = 90, at: str = "created_at") -> DataFrame:
    """Rows not older than ``days``: only what is strictly before the cutoff goes."""
    return rows.where(F.col(at) >= now - F.make_interval(days=F.lit(days)))


def tokens_stream(events: DataFrame, late: str = "1 hour", at: str = "blacklisted_at") -> DataFrame:
    """A stream with each token once within ``late`` of its first row; the watermark frees the state behind it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(["token"])


def activity_counts(events: DataFrame, at: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each window and key; on a stream, rows later than ``late`` are left out."""
    return (
        events.withWatermark(at, late)
        .groupBy(F.window(at, window).alias("w"), key)
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
        .select(F.col("w.start").alias("window_start"), key, "n", "total")
    )


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """A resumable backfill: takes what is there since the checkpoint in batches of its source, then ends."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def run_every(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 hour") -> StreamingQuery:
    """The same on a schedule; the first batch runs at once."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class _Stopped(Exception):
    """Raised in the batch after the one that asked for a stop, so that Spark does not commit it."""


def run_paced(stream: DataFrame, write: Callable[[DataFrame, int], bool], checkpoint: str, every: float = 2.0) -> bool:
    """Batches that begin at least ``every`` seconds apart, until ``write`` returns true, as for a rate limit, or the source has no more.

    Tells whether it was stopped. The batch that asked for the stop is done and committed; the
    next one fails before it writes, so it stays in the source's log and a later call begins
    with it. A run that is killed repeats its last batch under the same id: a ``write`` that
    keeps rows should go by ``runs.commit_once``.
    """
    began: list[float] = []
    stop: list[int] = []

    def one(batch: DataFrame, batch_id: int) -> None:
        if stop:
            raise _Stopped(f"stopped after batch {stop[0]}")
        if began:
            time.sleep(max(0.0, began[-1] + every - time.monotonic()))
        began[:] = [time.monotonic()]
        if write(batch, batch_id):
            stop.append(batch_id)

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if not stop or _Stopped.__name__ not in str(e):
            raise
    return bool(stop)
