import hashlib
import random

import numpy as np
import pytest

from quillsieve.llm.centroids import Centroids, cluster_vectors, largest_whole, oracle, reassign, squares


def plain_clusters(vectors, k, rounds, scale=256, seed="2:"):
    """Every vector against every centroid, in Python's whole numbers."""
    rows = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in vectors]
    digest = lambda i: hashlib.sha256(f"{seed}{'' if i is None else i}".encode()).hexdigest()
    cents = [x for _, x in sorted(rows, key=lambda r: (digest(r[0]), r[1]))[:k]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in rows]
        for n in range(len(cents)):
            mine = [x for (_, x), o in zip(rows, own, strict=True) if o == n]
            cents[n] = [sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else cents[n]
    return [(i, nearest(x)[1], nearest(x)[0], hashlib.sha256(",".join(map(str, cents[nearest(x)[1]])).encode()).hexdigest()) for i, x in rows]


@pytest.mark.parametrize("levels", [3, 1000])
def test_bounds_and_balls_change_nothing(levels):
    """Through rounds of moving centroids, few levels giving many ties, with fewer distances than all."""
    rng = np.random.default_rng(levels)
    spots = rng.integers(-levels, levels, (12, 6))
    x = spots[rng.integers(0, 12, 900)] + rng.integers(-1, 2, (900, 6)) * max(levels // 20, 1)
    cents, before = x[rng.permutation(900)[:20]].copy(), None
    state = [np.zeros(900, int), np.ones(900, int), np.full(900, np.inf), np.zeros(900)]
    took = 0
    for _ in range(8):
        *state, n = reassign(x, *state, Centroids.of(cents, before))
        took += n
        every = np.square(x[:, None] - cents[None]).sum(axis=2)
        assert (state[0] == every.argmin(axis=1)).all()
        own = every[np.arange(900), state[0]]
        assert (state[2] ** 2 >= own - 1e-6).all()
        every[np.arange(900), state[0]] = np.iinfo(np.int64).max
        assert (np.maximum(state[3], 0) ** 2 <= every.min(axis=1) + 1e-6).all()
        before, cents = cents, cents.copy()
        for c in range(20):
            if (state[0] == c).any():
                cents[c] = x[state[0] == c].sum(axis=0) // (state[0] == c).sum()
    assert took < 0.6 * 8 * 900 * 20 or levels == 3


def test_clusters_equal_the_plain_ones(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.5, 3.0]) + rng.random() / 50 for _ in range(4)]) for i in range(150)]
    rows += [(7, [0.0] * 4), (7, [0.0] * 4), (None, [1.0] * 4)]
    docs = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, x string, near int")
    for k, rounds in ((1, 2), (9, 5), (400, 1)):
        got = cluster_vectors(docs, dims=4, k=k, rounds=rounds)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        got = got.collect()
        want = plain_clusters(rows, k, rounds)
        assert sorted(map(repr, ((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got))) == sorted(map(repr, want))
        assert {r.inertia for r in got} == {sum(w[2] for w in want)}
        assert all(r.cluster_inertia == sum(w[2] for w in want if w[1] == r.cluster) for r in got)


def test_odd_vectors_go_and_an_empty_table_gives_none(spark):
    schema = "vec_id int, embedding array<float>"
    odd = [(1, None), (2, []), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [float("inf"), 0.0]), (6, [1.0, 2.0, 3.0])]
    assert cluster_vectors(spark.createDataFrame(odd, schema), dims=2).collect() == []
    got = cluster_vectors(spark.createDataFrame([*odd, (8, [0.5, -0.001])], schema), dims=2).collect()
    assert [(r.vec_id, r.cluster, r.distance) for r in got] == [(8, 0, 0)]
    assert got[0].centroid_sha256 == hashlib.sha256(b"128,-1").hexdigest()
    assert cluster_vectors(spark.createDataFrame([], schema)).collect() == []


def test_components_that_leave_no_room_are_an_error(spark):
    x = np.full((1, 64), largest_whole(64), np.int64)
    assert squares(x, -x)[0] > 0
    with pytest.raises(Exception, match="no room for exact distances"):
        cluster_vectors(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id int, embedding array<float>"), dims=2).collect()


def test_sql_states_the_same_rule():
    import duckdb

    con = duckdb.connect()
    con.execute("create table embeddings as select i as vec_id, [((i * 37 + j * 11) % 23) / 7.0 - 1.5 for j in range(0, 3)] as embedding from range(0, 90) t(i)")
    rows = con.execute("select vec_id, embedding from embeddings").fetchall()
    got = con.execute(oracle(dims=3, k=7, rounds=3)).fetchall()
    assert sorted((r[0], r[1], r[2], r[5]) for r in got) == sorted(plain_clusters(rows, 7, 3))
