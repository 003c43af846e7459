"""What several operators share: lineage cuts in the shared folder and runs of sorted Arrow rows."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.sources.config import checkpointed, shared_dir

__all__ = ["checkpointed", "complete_runs", "discard", "kept_columns", "materialised", "quoted", "release_shuffles", "shared_dir", "spread", "table", "text_bytes"]


def materialised(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder; for wide or many rows that several plans read."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/quillsieve-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._kept_at = path
    return found


def discard(df: DataFrame) -> None:
    """Removes the files of a ``materialised`` table that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._kept_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more, which it does when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A table of fewer parts than the session has cores, dealt to all of them: its row groups are too few tasks for work per row."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def kept_columns(docs: DataFrame, keep: list[str] | None, made: tuple[str, ...]) -> list[str]:
    """``keep``, or by default every column, without those that an operator makes anew under the same name."""
    new = {n.lower() for n in made}
    return [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]


def quoted(names: list[str]) -> list[F.Column]:
    return [F.col(f"`{n}`") for n in names]


def text_bytes(column: str) -> F.Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def complete_runs(batches: Iterator[pa.RecordBatch], key: str, rows: int = 65_536) -> Iterator[pa.Table]:
    """Re-cuts a stream that is sorted by ``key`` so that no key spans two tables; each has about ``rows`` rows or one longer run."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        whole = pa.Table.from_batches(held)
        keys = whole.column(key).to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if cut:
            yield whole.slice(0, cut)
        held = whole.slice(cut).combine_chunks().to_batches()
        size = whole.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)
