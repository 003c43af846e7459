"""Exact k-means in integers, with bounds that follow each vector through the rounds and a shrinking ball around the closer of two remembered centroids."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import discard, materialised

#: Float roots of exact squares are off by far less; every bound gives way by this share, so that no tie is missed.
_SLACK = 1e-9
_STATE = "id {id}, x array<int>, near int, other int, upper double, lower double"


@dataclass
class Centroids:
    """The centroids of a round, each one's neighbours by distance, and how far each moved since the round before."""

    at: np.ndarray
    moved: np.ndarray
    order: np.ndarray
    apart: np.ndarray

    @classmethod
    def of(cls, at: np.ndarray, before: np.ndarray | None = None) -> Centroids:
        moved = np.zeros(len(at)) if before is None else np.sqrt(np.square(at - before).sum(axis=1).astype(float))
        apart = np.sqrt(np.square(at[:, None] - at[None]).sum(axis=2).astype(float))
        apart[np.diag_indices(len(at))] = -1.0  # each leads its own row, also before an equal one
        order = np.argsort(apart, axis=1, kind="stable")
        return cls(at, moved, order, np.take_along_axis(apart, order, axis=1))

    def half_gap(self) -> np.ndarray:
        """Half of each one's distance to its nearest neighbour: what is closer than this has no nearer one."""
        return self.apart[:, 1] / 2 if len(self.at) > 1 else np.full(1, np.inf)

    def most_moved(self) -> np.ndarray:
        """For each centroid, the farthest move of any other one."""
        if len(self.at) == 1:
            return np.zeros(1)
        first, second = np.argsort(-self.moved, kind="stable")[:2]
        return np.where(np.arange(len(self.at)) == first, self.moved[second], self.moved[first])


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances in whole numbers, row by row."""
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


def reassign(
    x: np.ndarray, near: np.ndarray, other: np.ndarray, upper: np.ndarray, lower: np.ndarray, cents: Centroids
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest and second-nearest centroid of each row with new bounds, and how many distances that took.

    ``upper`` bounds the distance to ``near`` from above, ``lower`` that to every other
    centroid from below, both as of the round before. A row whose bounds still part, or that
    is closer than half of the gap around its centroid, keeps it. The others take
    exact distances to both remembered centroids and scan the neighbours of the closer one in
    order, out to its distance plus the second-best one, which shrinks as better ones are
    found. Equal distances go to the smaller number.
    """
    near, other = near.astype(np.int64), other.astype(np.int64)
    upper, lower = upper + cents.moved[near], lower - cents.most_moved()[near]
    half = cents.half_gap()
    if len(cents.at) == 1:
        return near * 0, near * 0, upper, np.full(len(x), np.inf), 0
    took = 0
    rows = np.flatnonzero(upper * (1 + _SLACK) >= np.maximum(lower, half[near]) * (1 - _SLACK))
    here = squares(x[rows], cents.at[near[rows]])
    took += len(rows)
    upper[rows] = np.sqrt(here.astype(float)) * (1 + _SLACK)
    unsure = upper[rows] >= np.maximum(lower[rows], half[near[rows]]) * (1 - _SLACK)
    rows, d1 = rows[unsure], here[unsure]
    n1, n2 = near[rows], other[rows]
    d2 = squares(x[rows], cents.at[n2])
    took += len(rows)
    swap = (d2 < d1) | ((d2 == d1) & (n2 < n1))
    n1, n2, d1, d2 = np.where(swap, n2, n1), np.where(swap, n1, n2), np.where(swap, d2, d1), np.where(swap, d1, d2)
    start, known = n1.copy(), n2.copy()
    reach = np.sqrt(d1.astype(float))
    for c in np.unique(start):
        inside = np.flatnonzero(start == c)
        for place in range(1, len(cents.at)):
            ball = (reach[inside] + np.sqrt(d2[inside].astype(float))) * (1 + _SLACK)
            inside = inside[cents.apart[c, place] <= ball]
            if not len(inside):
                break
            j = cents.order[c, place]
            new = inside[known[inside] != j]
            d = squares(x[rows[new]], cents.at[j])
            took += len(new)
            first = (d < d1[new]) | ((d == d1[new]) & (j < n1[new]))
            second = ~first & ((d < d2[new]) | ((d == d2[new]) & (j < n2[new])))
            a, b = new[first], new[second]
            n2[a], d2[a] = n1[a], d1[a]
            n1[a], d1[a] = j, d[first]
            n2[b], d2[b] = j, d[second]
    near[rows], other[rows] = n1, n2
    upper[rows] = np.sqrt(d1.astype(float)) * (1 + _SLACK)
    lower[rows] = np.sqrt(d2.astype(float)) * (1 - _SLACK)
    return near, other, upper, lower, took


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def largest_whole(dims: int) -> int:
    """The largest component that keeps every squared distance within 64 bits."""
    return math.isqrt((2**63 - 1) // dims) // 2


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """``(id, x)`` of the vectors of exactly ``dims`` components, none null or non-finite, each as floor(scale * component)."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    sound = (F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    far = F.exists("v", lambda x: F.abs(x * scale) > largest_whole(dims))
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("int"))
    message = F.lit(f"a component beyond {largest_whole(dims)} after scaling leaves no room for exact distances")
    return vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where(sound).select("id", F.when(far, F.raise_error(message)).otherwise(whole).alias("x"))


def _round(cents: Centroids, dims: int, spark):
    sent = spark.sparkContext.broadcast(cents)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                some = batch.slice(k, 4096)
                state = [some.column(n).to_numpy(zero_copy_only=False) for n in ("near", "other", "upper", "lower")]
                near, other, upper, lower, _ = reassign(_matrix(some.column("x"), dims), *state, sent.value)
                made = [pa.array(near, pa.int32()), pa.array(other, pa.int32()), pa.array(upper), pa.array(lower)]
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("x"), *made], ["id", "x", "near", "other", "upper", "lower"])

    return assign


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: str = "2:"
) -> DataFrame:
    """Each kept vector's cluster, squared distance, the sums of these over its cluster and over all, and its centroid's digest.

    Centroids start as the ``k`` vectors whose ids, after ``seed``, have the smallest SHA-256
    in hex, in that order; a round assigns every vector to the nearest centroid and sets each
    to the floor of its vectors' means; then vectors are assigned once more. Everything is
    exact in whole numbers. Ties of distance go to the smaller number; an empty centroid stays.

    A round is one task per part of the state table, without a shuffle of vectors; each
    vector's two remembered centroids and bounds lie beside it in the shared folder, so a lost
    executor repeats only its part. The means come from grouped sums, combined before they are
    shuffled, of which ``k`` rows reach the driver; a centroid that attracts most vectors is
    one row of each task. Vectors that are null, of another length or that hold nulls, NaN or
    infinities are left out; repeated rows each count and, among starting centroids, are told
    apart by their components; a null id hashes as no text; an empty table gives no row; other
    columns are ignored. Components beyond ``largest_whole`` stop the job by an error.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vector_col, dims, scale)
    id_type = rows.schema["id"].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    seeds = rows.orderBy(digest, "x").limit(k).select("x").collect()
    columns = f"{id_col} {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not seeds:
        return spark.createDataFrame([], columns)
    at, before = np.array([r.x for r in seeds], np.int64), None
    cents = Centroids.of(at)
    start = [F.lit(0).alias("near"), F.lit(min(1, len(at) - 1)).alias("other"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower")]
    state = rows.select("id", "x", *start)
    for turn in range(rounds):
        new = materialised(state.mapInArrow(_round(cents, dims, spark), _STATE.format(id=id_type)))
        if turn:
            discard(state)
        state = new
        sums = state.groupBy("near").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[i].cast("long")) for i in range(dims)]).alias("s")).collect()
        before, at = at, at.copy()
        for r in sums:
            at[r.near] = [s // r.n for s in r.s]
        cents = Centroids.of(at, before)
    sent = spark.sparkContext.broadcast(cents)
    last = _round(cents, dims, spark)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in last(batches):
            near = batch.column("near").to_numpy()
            gaps = squares(_matrix(batch.column("x"), dims), sent.value.at[near])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("near"), pa.array(gaps, pa.int64())], ["id", "cluster", "distance"])

    found = materialised(state.mapInArrow(measure, f"id {id_type}, cluster int, distance long"))
    if rounds:
        discard(state)
    totals = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    each = F.array(*[F.lit(totals.get(c, 0)).cast("long") for c in range(len(at))])
    names = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in at.tolist()])
    return found.select(
        F.col("id").alias(id_col), "cluster", "distance", F.get(each, F.col("cluster")).alias("cluster_inertia"), F.lit(sum(totals.values())).cast("long").alias("inertia"),
        F.get(names, F.col("cluster")).alias("centroid_sha256"),
    )


def oracle(dims: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: str = "2:") -> str:
    """The same rows in DuckDB SQL, by comparing every vector with every centroid."""
    gap = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
    steps = [
        f"kept as (select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as x from embeddings"
        f" where len(embedding) = {dims} and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))))",
        f"c0 as (select row_number() over (order by sha256('{seed}' || vec_id), x) - 1 as k, x as c from kept order by sha256('{seed}' || vec_id), x limit {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} as (select vec_id, x, min(struct_pack(d := d, k := k)) as b from (select vec_id, x, k, {gap} as d from kept, c{r}) group by vec_id, x)")
        if r < rounds:
            steps.append(
                f"m{r} as (select k, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as c from (select b.k as k, i, sum(x[i]) as s, count(*) as n from a{r}, range(1, {dims + 1}) t(i) group by all) group by k),"
                f" c{r + 1} as (select p.k, coalesce(m.c, p.c) as c from c{r} p left join m{r} m on m.k = p.k)"
            )
    return (
        f"with {', '.join(steps)} select vec_id, b.k::int as cluster, b.d as distance, (sum(b.d) over (partition by b.k))::bigint as cluster_inertia,"
        f" (sum(b.d) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256 from a{rounds} join c{rounds} on c{rounds}.k = b.k"
    )
