"""Runs that are killed, repeated, stopped and resumed."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quillsieve.streaming import blacklist, runs, state


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / name)


def _feed(spark, folder, n=8, rows=10):
    source = folder("in")
    for k in range(n):
        spark.range(k * rows, (k + 1) * rows).coalesce(1).write.mode("append").parquet(source)
    return lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)


@pytest.mark.parametrize("when", ["after the write", "after the rename", "after the batch"])
def test_a_killed_batch_is_kept_once(spark, folder, monkeypatch, when):
    stream, publish = _feed(spark, folder, 5), runs._publish
    died = []

    def dies(*args):
        if when == "after the rename":
            publish(*args)
        if not died and args[2].endswith("batch=2"):
            died.append(1)
            raise RuntimeError("killed")
        return when == "after the rename" or publish(*args)

    def write(batch, batch_id):
        runs.once(folder("out"), "r")(batch, batch_id)
        if when == "after the batch" and not died and batch_id == 2:
            died.append(1)
            raise RuntimeError("killed")

    if when != "after the batch":
        monkeypatch.setattr(runs, "_publish", dies)
    with pytest.raises(Exception, match="killed"):
        state.run_available(stream(), write, folder("mark")).awaitTermination()
    assert died
    state.run_available(stream(), write, folder("mark")).awaitTermination()
    assert sorted(r.id for r in runs.committed(spark, folder("out"), "id long").collect()) == list(range(50))


def test_two_runs_and_readers_of_nothing(spark, folder):
    rows = spark.range(3)
    assert runs.committed(spark, folder("out"), "id long").count() == 0
    assert [runs.commit_once(rows, folder("out"), r, 0) for r in "aba"] == [True, True, False]
    assert runs.committed(spark, folder("out"), "id long").count() == 6
    assert not runs._publish(spark, _written(rows, folder("x")), folder("out") + "/run=a/batch=0")
    assert runs.committed(spark, folder("out"), "id long").count() == 6


def _written(rows, path):
    rows.write.parquet(path)
    return path


def test_paced_runs_stop_and_go_on_without_a_lost_row(spark, folder):
    rng = random.Random(1)
    stream, stops = _feed(spark, folder, 12), 0
    for turn in range(40):

        def write(batch, batch_id):
            runs.commit_once(batch, folder("out"), "r", batch_id)
            return rng.random() < 0.6

        if not state.run_paced(stream(), write, folder("mark"), every=0.0):
            break
        stops += 1
    assert stops > 3
    assert sorted(r.id for r in runs.committed(spark, folder("out"), "id long").collect()) == list(range(120))


def test_paced_runs_keep_their_pace_and_real_errors(spark, folder):
    import time

    stream, began = _feed(spark, folder, 3), []
    assert not state.run_paced(stream(), lambda b, i: began.append(time.monotonic()), folder("mark"), every=0.7)
    assert len(began) == 3 and min(b - a for a, b in zip(began, began[1:], strict=False)) >= 0.69

    def broken(batch, batch_id):
        raise ValueError("no disk")

    with pytest.raises(Exception, match="no disk"):
        state.run_paced(stream(), broken, folder("other"), every=0.0)


def test_a_lease_has_one_holder_and_runs_out(spark, folder):
    now = [100.0]
    a, b = (runs.RunLease(spark, folder("l"), "playlist 7", seconds=10, clock=lambda: now[0]) for _ in "ab")
    assert a.acquire() and not b.acquire() and a.renew()
    assert runs.RunLease(spark, folder("l"), "playlist 8").acquire()
    done = []
    assert not runs.run_exclusive(b, lambda: done.append(1)) and not done
    now[0] = 111.0
    assert not a.held() and b.acquire() and not a.renew()
    a.release()
    assert b.held()
    b.release()
    with pytest.raises(ZeroDivisionError):
        runs.run_exclusive(a, lambda: 1 / 0)
    assert runs.run_exclusive(b, lambda: done.append(1)) and done == [1]


def test_backfill_takes_each_version_once_over_a_growing_table(spark, folder):
    day = datetime.datetime(2024, 1, 1)
    rows = [(k, day + datetime.timedelta(hours=k // 4), k % 5) for k in range(40)]
    schema = "id long, updated_at timestamp, x int"

    def work(step):
        return step.where("x <> 1").select("id", (F.col("x") != 3).alias("ok"), (F.col("x") * 2).alias("twice"))

    make = lambda: runs.Backfill(spark, folder("b"), "r", work, limit=7)
    seen = []
    for turn in range(30):
        now = rows[: 10 + 6 * turn]
        if turn == 4:
            rows[0] = (0, day + datetime.timedelta(days=9), 2)  # changed after it was done
        step = make().step(spark.createDataFrame([*now, (None, day, 1), (99, None, 1)], schema))
        seen.append(step.taken)
        if turn > 6 and not step.taken:
            break
    assert max(seen) == 7 and make().step(spark.createDataFrame(rows, schema)).taken == 0
    got = sorted((r.id, r.ok, r.twice) for r in make().results().collect())
    assert got == sorted([(k, x not in (1, 3), None if x == 1 else 2 * x) for k, _, x in rows] + [(0, True, 0)])
    assert sorted(r.id for r in make().failed().collect()) == [k for k, _, x in rows if x in (1, 3)]
    assert make().mark() == (day + datetime.timedelta(days=9), 0)


def test_a_backfill_that_dies_does_its_step_anew(spark, folder, monkeypatch):
    rows = spark.range(10).select("id", F.lit(datetime.datetime(2024, 1, 1)).alias("updated_at"))
    fill = runs.Backfill(spark, folder("b"), "r", lambda s: s.select("id", F.lit(True).alias("ok")), limit=4)
    fill.step(rows)
    publish = runs._publish
    monkeypatch.setattr(runs, "_publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        fill.step(rows)
    monkeypatch.setattr(runs, "_publish", publish)
    assert [fill.step(rows).taken for _ in range(3)] == [4, 2, 0]
    assert sorted(r.id for r in fill.results().collect()) == list(range(10))
    cut = runs.Backfill(spark, folder("c"), "r", fill.work)
    assert cut.step(rows, before=F.lit(datetime.datetime(2024, 1, 1))).taken == 0 and cut.mark() is None


def test_tokens_expire_one_by_one_and_a_restart_keeps_them(spark, folder):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    t = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    batches = [
        [("a", "add", t(0), "u1", t(10), "logout"), ("b", "add", t(0), "u2", t(30), "security"), ("c", "add", t(0), "u3", t(20), "logout"), ("d", "add", t(0), "u4", t(5), "logout"), ("a", "ask", t(1), None, None, None), ("z", "ask", t(1), None, None, None)],
        [("a", "ask", t(10), None, None, None), ("b", "ask", t(11), None, None, None), ("c", "add", t(12), "u3", t(60), "admin_action")],
        [("a", "ask", t(13), None, None, None), (None, "ask", t(13), None, None, None)],
        [("z", "ask", t(45), None, None, None)],
        [("b", "ask", t(46), None, None, None), ("c", "ask", t(46), None, None, None)],
        [("z", "ask", t(90), None, None, None)],
        [("c", "ask", t(91), None, None, None)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, blacklist.EVENTS).coalesce(1).write.mode("append").parquet(folder("in"))
        events = spark.readStream.schema(blacklist.EVENTS).parquet(folder("in"))
        state.run_available(blacklist.token_answers(events, sweep_seconds=3600), runs.once(folder("out"), "r"), folder("mark")).awaitTermination()
    got = [(r.token, r.kind, r.at, r.blacklisted, r.reason) for r in runs.committed(spark, folder("out"), blacklist.ANSWERS).collect()]
    asked = sorted((token, at, is_on, why) for token, kind, at, is_on, why in got if kind == "answer")
    assert asked == sorted([
        ("a", t(1), True, "logout"), ("z", t(1), False, None), ("a", t(10), True, "logout"), ("b", t(11), True, "security"), ("a", t(13), False, None),
        ("z", t(45), False, None), ("b", t(46), False, None), ("c", t(46), True, "admin_action"), ("z", t(90), False, None), ("c", t(91), False, None),
    ], key=lambda r: r[:2])
    assert sorted((token, at) for token, kind, at, _, _ in got if kind == "swept") == [("d", t(5))]  # the others were cleared when they were asked for
