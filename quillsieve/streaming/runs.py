"""Runs that can be killed and repeated: sinks that commit a batch once, leases against double work, and a backfill with a stored mark."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillsieve.sources.config import checkpointed


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and the path, as Hadoop objects."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _publish(spark: SparkSession, stage: str, target: str) -> bool:
    """Renames a written folder to its final name; false, and the folder goes, where that name is taken."""
    fs, source = _files(spark, stage)
    _, goal = _files(spark, target)
    fs.mkdirs(goal.getParent())
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(fs.makeQualified(source), fs.makeQualified(goal), options)
    except Py4JJavaError as e:
        if not fs.exists(goal):
            raise e
        fs.delete(source, True)
        return False
    return True


def commit_once(batch: DataFrame, path: str, run: str, batch_id: int) -> bool:
    """Keeps ``batch`` as ``path``/run=…/batch=…; false where the run's batch of that number is there already, which stays as it is.

    The rows are written to a hidden folder and appear by one rename, so readers see whole
    batches only, and a batch that Spark repeats after a crash, before or after the rename,
    is kept once. Needs a file system that renames folders atomically, as HDFS does.
    """
    spark = batch.sparkSession
    target = f"{path.rstrip('/')}/run={run}/batch={batch_id}"
    fs, goal = _files(spark, target)
    if fs.exists(goal):
        return False
    stage = f"{path.rstrip('/')}/_staging/{run}-{batch_id}-{uuid.uuid4().hex}"
    batch.write.parquet(stage)
    return _publish(spark, stage, target)


def once(path: str, run: str, change: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that keeps what ``change`` makes of each batch once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        commit_once(change(batch), path, run, batch_id)

    return write


def committed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all committed batches under ``path``; none before the first one."""
    fs, folder = _files(spark, path)
    if not fs.exists(folder):
        return spark.createDataFrame([], schema)
    names = (schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema).names
    return spark.read.schema(schema).parquet(path).select(*names)


@dataclass
class RunLease:
    """One worker at a time for a key, as a file that is created only where none is; one that is not renewed within ``seconds`` can be taken.

    A worker that was taken for dead and comes back finds that it no longer holds the lease;
    what it still writes by ``commit_once`` is kept at most once.
    """

    spark: SparkSession
    folder: str
    key: str
    seconds: float = 900.0
    owner: str = field(default_factory=lambda: uuid.uuid4().hex)
    clock: Callable[[], float] = time.time

    @property
    def _path(self) -> str:
        return f"{self.folder.rstrip('/')}/_leases/{uuid.uuid5(uuid.NAMESPACE_URL, self.key).hex}"

    def _read(self) -> dict | None:
        fs, path = _files(self.spark, self._path)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)) or "{}")
        finally:
            stream.close()

    def _write(self, overwrite: bool) -> bool:
        fs, path = _files(self.spark, self._path)
        try:
            out = fs.create(path, overwrite)
        except Py4JJavaError:
            if not fs.exists(path):
                raise
            return False
        out.write(bytearray(json.dumps({"owner": self.owner, "until": self.clock() + self.seconds}).encode()))
        out.close()
        return True

    def held(self) -> bool:
        """Whether this worker has the lease and it has not run out."""
        now = self._read()
        return bool(now) and now.get("owner") == self.owner and now["until"] > self.clock()

    def acquire(self) -> bool:
        """True for the one worker that now has the lease."""
        if self._write(overwrite=False):
            return self.held()
        now = self._read()
        if now and now.get("owner") != self.owner and now["until"] > self.clock():
            return False
        return self._write(overwrite=True) and self.held()

    def renew(self) -> bool:
        return self.held() and self._write(overwrite=True)

    def release(self) -> None:
        now = self._read()
        if now and now.get("owner") == self.owner:
            fs, path = _files(self.spark, self._path)
            fs.delete(path, False)


def run_exclusive(lease: RunLease, work: Callable[[], None]) -> bool:
    """Does ``work`` if no other worker has the lease; false, and nothing happens, if one has. The lease goes also when the work fails."""
    if not lease.acquire():
        return False
    try:
        work()
    finally:
        lease.release()
    return True


def unclaimed(runs: DataFrame, claims: DataFrame, now: Column, key: str) -> DataFrame:
    """The interrupted runs (status PROCESSING) that no live claim (key, expires_at) holds: what a restart may take up."""
    live = claims.where(F.col("expires_at") > now).select(key).distinct()
    return runs.where(F.col("status") == "PROCESSING").join(live, key, "left_anti")


@dataclass(frozen=True)
class BackfillStep:
    """How many rows a step took, how many of these failed, and the mark (time, key) that it left."""

    taken: int
    failed: int
    mark: tuple | None


class Backfill:
    """Goes through a growing table by (``at``, ``key``), at most ``limit`` rows a step, each version of a row once over all runs of one name.

    ``work`` takes the rows of a step and returns (key, ok) with what else it keeps; a row
    that it does not return has failed. A step's rows appear by one rename, and the mark is
    the greatest (time, key) among them, so a step that was killed is done anew and none is done twice. Rows
    of one time are told apart by their key. Rows must not arrive with a time before the
    mark: choose ``before`` early enough for late ones. Rows without time or key are left out.
    """

    def __init__(self, spark: SparkSession, path: str, run: str, work: Callable[[DataFrame], DataFrame], at: str = "updated_at", key: str = "id", limit: int = 10_000):
        self.spark, self.path, self.run, self.work, self.at, self.key, self.limit = spark, path.rstrip("/"), run, work, at, key, limit

    def _steps(self) -> int:
        fs, folder = _files(self.spark, f"{self.path}/run={self.run}")
        if not fs.exists(folder):
            return 0
        return len(fs.listStatus(folder))

    def mark(self) -> tuple | None:
        """The greatest (time, key) done; the last step holds it."""
        steps = self._steps()
        if not steps:
            return None
        last = self.spark.read.parquet(f"{self.path}/run={self.run}/batch={steps - 1}")
        top = last.agg(F.max(F.struct(self.at, self.key)).alias("m")).first().m
        return tuple(top) if top else None

    def pending(self, rows: DataFrame, before: Column | None = None) -> DataFrame:
        mark, at, key = self.mark(), F.col(self.at), F.col(self.key)
        left = rows.where(at.isNotNull() & key.isNotNull())
        if before is not None:
            left = left.where(at < before)
        if mark is not None:
            time_, id_ = F.lit(mark[0]), F.lit(mark[1])
            left = left.where((at > time_) | ((at == time_) & (key > id_)))
        return left

    def step(self, rows: DataFrame, before: Column | None = None) -> BackfillStep:
        """Takes the next rows; a step of none leaves no trace."""
        number = self._steps()
        taken = checkpointed(self.pending(rows, before).orderBy(self.at, self.key).limit(self.limit))
        done = self.work(taken)
        kept = taken.select(self.at, self.key).join(done.drop(self.at), self.key, "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
        n = taken.count()
        if not n:
            return BackfillStep(0, 0, self.mark())
        commit_once(kept, self.path, self.run, number)
        failed = self.spark.read.parquet(f"{self.path}/run={self.run}/batch={number}").where("not ok").count()
        return BackfillStep(n, failed, self.mark())

    def results(self) -> DataFrame:
        """Every row done so far: time, key, ok and what the work kept."""
        return self.spark.read.parquet(f"{self.path}/run={self.run}").drop("batch")

    def failed(self) -> DataFrame:
        """The keys whose last try failed, with its time."""
        last = self.results().groupBy(self.key).agg(F.max_by("ok", self.at).alias("ok"), F.max(self.at).alias(self.at))
        return last.where("not ok").select(self.key, self.at)
