"""Session settings, validated options and lineage cuts."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: For sessions of our own; UTC so that timestamps compare, adaptive plans for skew and small partitions.
SESSION = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "quillsieve", **extra: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=SESSION | extra).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where that is unset, a session on one machine gets a folder of its own; on a cluster it
    must be set, as executors would not see a folder of the driver's.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillsieve-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@dataclass(frozen=True)
class CurationConfig:
    """Ranges as the service accepts them; out of range raises, only runs are clamped."""

    near_threshold: float = 0.8
    ngram: int = 3
    runs: int = 1

    @classmethod
    def of(cls, values: dict[str, str]) -> CurationConfig:
        threshold = float(values.get("near_threshold") or 0.8)
        ngram = int(values.get("ngram") or 3)
        runs = int(values.get("runs") or 1)
        if not 0 <= threshold <= 1 or not 1 <= ngram <= 10 or not 1 <= runs <= 5:
            raise ValueError("near_threshold is 0 to 1, ngram 1 to 10, runs 1 to 5")
        return cls(threshold, ngram, runs)
