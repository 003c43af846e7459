"""A sink of serialised records whose parts, joined in the order of their names, are one valid file."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

_TEMPORARY = "_temporary"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _Part(WriterCommitMessage):
    partition: int
    name: str
    records: int


class DatasetSink(DataSource):
    """``format("dataset_files")``: text records of one column, in the order of the partitions.

    Options: ``path``; ``between`` two records; ``head``, ``tail`` and, for no record at
    all, ``head_empty``, ``tail_empty``, in which ``{n}`` becomes the number of records. Tasks write
    to a hidden folder. The commit knows which parts have records, so it adds the
    head, a separator before each later part and the tail, and only then the folder
    holds its files; a failed job leaves nothing but what was there before. Attempts of one task have names of their own, and only those that Spark commits are taken.
    """

    @classmethod
    def name(cls) -> str:
        return "dataset_files"

    def schema(self) -> str:
        return "record string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _DatasetWriter(dict(self.options), overwrite)


class _DatasetWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.options, self.overwrite, self.job = options, overwrite, uuid.uuid4().hex
        self.path = options["path"].rstrip("/")

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        files, path = _opened(self.path)
        return files, path, f"{path}/{_TEMPORARY}/{self.job}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        files, _, folder = self._folder()
        files.create_dir(folder)
        task = TaskContext.get()
        name, between, n = f"{task.partitionId()}-{uuid.uuid4().hex}", self.options.get("between", "\n").encode(), 0
        with files.open_output_stream(f"{folder}/{name}") as out:
            for row in iterator:
                out.write(between + (row[0] or "").encode() if n else (row[0] or "").encode())
                n += 1
        return _Part(task.partitionId(), name, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, path, folder = self._folder()
        parts = sorted((m for m in messages if m is not None and m.records), key=lambda m: m.partition)
        n = sum(p.records for p in parts)
        if self.overwrite:
            found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
            for old in found:
                if old.type == fs.FileType.File:
                    files.delete_file(old.path)
        head, tail = (self.options.get(k if n else f"{k}_empty", "").replace("{n}", str(n)) for k in ("head", "tail"))
        files.create_dir(path)
        self._put(files, f"{path}/part-0000000-head", head)
        for place, part in enumerate(parts, 1):
            if place > 1:
                self._put(files, f"{path}/part-{place:07}-a", self.options.get("between", "\n"))
            files.move(f"{folder}/{part.name}", f"{path}/part-{place:07}-b")
        self._put(files, f"{path}/part-9999999-tail", tail)
        self._drop(files, path, folder)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop(*self._folder())

    @staticmethod
    def _put(files: fs.FileSystem, path: str, text: str) -> None:
        with files.open_output_stream(path) as out:
            out.write(text.encode())

    @staticmethod
    def _drop(files: fs.FileSystem, path: str, folder: str) -> None:
        for gone in (folder, f"{path}/{_TEMPORARY}"):
            info = files.get_file_info(gone)
            if info.type == fs.FileType.Directory and (gone == folder or not files.get_file_info(fs.FileSelector(gone))):
                files.delete_dir(gone)
