"""Calls to slow services from tasks: several in flight, in order, tried again, and slow enough together."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import TypeVar

from pyspark.sql import DataFrame

X = TypeVar("X")
Y = TypeVar("Y")

_GATE = threading.Lock()
_NEXT: dict[str, float] = {}


@dataclass(frozen=True)
class RateLimit:
    """At most ``per_second`` calls of one service, named ``key``, over a session's tasks.

    ``shared`` divides the rate by the tasks that can run at once, so tasks need not know
    of each other; each worker spaces its own calls by its share.
    """

    key: str
    per_second: float

    def shared(self, rows: DataFrame) -> RateLimit:
        return replace(self, per_second=self.per_second / max(rows.sparkSession.sparkContext.defaultParallelism, 1))

    def wait(self) -> None:
        """Returns when this worker may call."""
        with _GATE:
            now = time.monotonic()
            at = max(now, _NEXT.get(self.key, now))
            _NEXT[self.key] = at + 1 / self.per_second
        time.sleep(max(0.0, at - now))


def in_flight(items: Iterable[X], call: Callable[[X], Y], window: int = 6, attempts: int = 1, rate: RateLimit | None = None) -> Iterator[Y | None]:
    """``call`` of each item in their order, ``window`` at once; none where it raised ``attempts`` times.

    Items are taken as answers leave, so neither grows with the stream.
    """

    def tried(item: X) -> Y | None:
        for _ in range(attempts):
            if rate is not None:
                rate.wait()
            try:
                return call(item)
            except Exception:  # noqa: BLE001, S112  a provider may fail in any way
                continue
        return None

    flying: deque[Future] = deque()
    with ThreadPoolExecutor(window) as pool:
        for item in items:
            flying.append(pool.submit(tried, item))
            if len(flying) >= window:
                yield flying.popleft().result()
        while flying:
            yield flying.popleft().result()
