"""Blacklisted tokens as keyed state of a stream: entries, look-ups with lazy eviction, and a timer that sweeps what has expired."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "token string, kind string, at timestamp, user_id string, expires_at timestamp, reason string"
ANSWERS = "token string, kind string, at timestamp, blacklisted boolean, user_id string, reason string"


def _millis(t: datetime) -> int:
    return int((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def _moment(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)


class _Tokens(StatefulProcessor):
    """One value a token: when it expires, in milliseconds, whose it is and why."""

    def __init__(self, sweep: int):
        self.sweep = sweep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "expires long, user_id string, reason string")

    def _swept_at(self, expires: int) -> int:
        return (expires // self.sweep + 1) * self.sweep

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        # state and timers are calls to the JVM: one reading and one writing a token and batch
        before = found = self.entry.get() if self.entry.exists() else None
        for row in sorted(rows, key=lambda r: (r.at, r.kind)):
            if row.kind == "add" and row.expires_at is not None:
                found = (_millis(row.expires_at), row.user_id, row.reason)
            elif row.kind == "ask":
                if found is not None and found[0] < _millis(row.at):
                    found = None
                yield Row(token=key[0], kind="answer", at=row.at, blacklisted=found is not None, user_id=found and found[1], reason=found and found[2])
        if found == before:
            return
        if before is not None:
            self.handle.deleteTimer(self._swept_at(before[0]))
        if found is None:
            self.entry.clear()
        else:
            self.entry.update(found)
            self.handle.registerTimer(self._swept_at(found[0]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        if self.entry.exists():
            expires, user, reason = self.entry.get()
            self.entry.clear()
            yield Row(token=key[0], kind="swept", at=_moment(expires), blacklisted=False, user_id=user, reason=reason)

    def close(self) -> None:
        pass


def token_answers(events: DataFrame, late: str = "0 seconds", sweep_seconds: int = 3600) -> DataFrame:
    """``ANSWERS`` of a stream of ``EVENTS``: one row for each ``ask``, and a ``swept`` row when an entry that nobody asked for has expired.

    An ``add`` replaces a token's entry. An ``ask`` after the expiry clears the entry and
    answers false; at the very expiry it is still true. Entries are swept at the first whole
    ``sweep_seconds`` after their expiry that the watermark (events may be ``late``) has
    passed, so state is freed for tokens that never come again. State is kept in RocksDB by
    token; a restart goes on from the checkpoint. Within a batch a token's rows go by their
    time, an ``add`` before an ``ask`` of one instant. Rows without a token or time are left out. Set
    ``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider.
    """
    rows = events.select("token", "kind", "at", "user_id", "expires_at", "reason").where("token is not null and at is not null")
    return rows.withWatermark("at", late).groupBy("token").transformWithState(_Tokens(sweep_seconds * 1000), ANSWERS, "Append", "EventTime")
