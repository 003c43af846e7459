"""Playlist listings as a stream: page tokens are its offsets, failed pages become error rows, and captions are fetched where their rows are."""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quillsieve.operators.calls import RateLimit, in_flight

ITEMS = "playlist_id string, page_no int, at int, video_id string, title string, error string"
#: Takes (playlist, page token) and returns (items, next token or None).
Fetch = Callable[[str, str | None], tuple[list[dict], str | None]]


def named(function: str):
    """The function that ``module:function`` names, on whichever machine asks."""
    module, _, name = function.partition(":")
    return getattr(importlib.import_module(module), name)


def tried(fetch: Fetch, playlist: str, token: str | None, attempts: int, pause: float) -> tuple[list[dict], str | None, str | None]:
    """(items, next token, error); the pause doubles after every failure."""
    for turn in range(attempts):
        try:
            return (*fetch(playlist, token), None)
        except Exception as e:  # noqa: BLE001  a service may fail in any way
            error = f"{type(e).__name__}: {e}"
            if turn + 1 < attempts:
                time.sleep(pause * 2**turn)
    return [], None, error


@dataclass
class _Pages(InputPartition):
    playlist: str
    page: int
    token: str | None
    pages: int


class ListingSource(DataSource):
    """``readStream.format("playlist_listing")``: the items of playlists, page by page.

    Options: ``playlists`` (comma-separated), ``fetch`` (``module:function`` of a ``Fetch``), ``pages``
    of each playlist a batch (default 10), ``attempts`` (3) and ``pause`` seconds (0.5) of a failing
    page. The offset holds, for each playlist, the number of its next page and
    that page's token, or that its listing has ended, so a stream that was stopped in mid-listing goes on at
    its page, and no page is read twice by later batches. To know a batch's end the driver walks the tokens of
    its pages; items are read by one task a playlist. A page that fails every attempt ends its playlist with one row that
    has only ``error``. Items without a video are left out; ``at`` is an item's place on its page.
    """

    @classmethod
    def name(cls) -> str:
        return "playlist_listing"

    def schema(self) -> str:
        return ITEMS

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _ListingReader(dict(self.options))


class _ListingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.playlists = sorted({p.strip() for p in options["playlists"].split(",") if p.strip()})
        self.fetch, self.pages = options["fetch"], int(options.get("pages", 10))
        self.attempts, self.pause = int(options.get("attempts", 3)), float(options.get("pause", 0.5))
        self.at: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {p: json.dumps([0, None]) for p in self.playlists}

    def latestOffset(self) -> dict:  # noqa: N802
        now = self.at or self.initialOffset()
        fetch, then = named(self.fetch), {}
        for playlist in self.playlists:
            page, token = json.loads(now.get(playlist, "[0, null]"))
            for _ in range(self.pages):
                if page < 0:
                    break
                _, token, error = tried(fetch, playlist, token, self.attempts, self.pause)
                page = page + 1 if token else -page - 1  # a negative number ends the listing after that many pages
            then[playlist] = json.dumps([page, token])
        self.at = then
        return then

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = end
        found = []
        for playlist in sorted(end):
            (page, token), (last, _) = json.loads(start.get(playlist, "[0, null]")), json.loads(end[playlist])
            if page >= 0 and abs(last) > page:
                found.append(_Pages(playlist, page, token, abs(last) - page))
        return found

    def read(self, partition: _Pages) -> Iterator[tuple]:
        fetch, token = named(self.fetch), partition.token
        for page in range(partition.page, partition.page + partition.pages):
            items, token, error = tried(fetch, partition.playlist, token, self.attempts, self.pause)
            if error:
                yield partition.playlist, page, None, None, None, error
                return
            for k, item in enumerate(items):
                if item.get("video_id"):
                    yield partition.playlist, page, k, item["video_id"], item.get("title"), None
            if not token:
                return

    def commit(self, end: dict) -> None:
        self.at = end


def fetched_captions(
    items: DataFrame, fetch: Callable[[str], dict | None], video: str = "video_id", attempts: int = 2, window: int = 6, rate: RateLimit | None = None
) -> DataFrame:
    """``items`` with the caption that ``fetch`` gives for each video: ``success``, ``language_code``, ``raw_text`` and ``error_type``.

    A task keeps ``window`` calls in flight; a call is tried ``attempts`` times. None is no
    caption (``no_transcript``), an error that lasts is ``api_error``, an id under eight
    characters or none is ``invalid_video_id`` and is not asked for. Works on streams too.
    """
    made = ("success", "language_code", "raw_text", "error_type")
    kept = [c for c in items.columns if c not in made]
    schema = ", ".join([f"`{n}` {t}" for n, t in items.dtypes if n in kept] + ["success boolean", "language_code string", "raw_text string", "error_type string"])
    limit = rate.shared(items) if rate else None

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            valid = [isinstance(v, str) and len(v) >= 8 for v in batch[video]]
            answers = in_flight([v for v, ok in zip(batch[video], valid, strict=True) if ok], lambda v: (fetch(v),), window, attempts, limit)
            rows = []
            for ok in valid:
                got = next(answers) if ok else None
                if not ok:
                    rows.append((False, None, None, "invalid_video_id"))
                elif got is None:
                    rows.append((False, None, None, "api_error"))
                elif got[0] is None:
                    rows.append((False, None, None, "no_transcript"))
                else:
                    rows.append((True, got[0].get("language_code"), got[0].get("raw_text"), None))
            yield batch.assign(**{name: pd.Series([r[k] for r in rows], index=batch.index, dtype="object") for k, name in enumerate(made)})

    return items.select(*kept).mapInPandas(answered, schema)


def numbered(items: DataFrame) -> DataFrame:
    """Listed items with ``video_index``, their place among the usable ones of their playlist, from 1."""
    from pyspark.sql import Window

    w = Window.partitionBy("playlist_id").orderBy("page_no", "at")
    return items.where("error is null").withColumn("video_index", F.row_number().over(w)).drop("error")
