"""How ordered filters interact: what each removes, repeats of others' work and loses, for every order, from additive counts of failure masks."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import checkpointed

FILTERS = "ABCDE"
_SHARD = 1 << 18
_PROBES = 4


def sketch_places(digests: np.ndarray, counters: int) -> np.ndarray:
    """The ``_PROBES`` counters of each 64-bit digest, by double hashing; ``counters`` is a power of two."""
    h = digests.view(np.uint64)
    step = (h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    return ((h[:, None] + np.arange(_PROBES, dtype=np.uint64) * step[:, None]) & np.uint64(counters - 1)).astype(np.int64)


def sketch_size(rows: int, most_counters: int) -> int:
    """Sixteen counters a row, as a power of two within one shard and ``most_counters``."""
    return min(max(1 << math.ceil(math.log2(max(16 * rows, 1))), _SHARD), most_counters)


def duplicate_sketch(digests: DataFrame, counters: int) -> np.ndarray:
    """A merged counting Bloom filter of a column ``h``: for each counter whether two rows or more fell on it, as packed bits.

    A task counts its own rows first and sends every place that it met once or more often,
    so that a text of very many copies is a few places; the counts of a range of places are added in one task,
    in memory of its size. ``counters`` / 8 bytes reach the driver.
    """
    size = min(_SHARD, counters)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            met, n = np.unique(sketch_places(batch.column(0).to_numpy(), counters), return_counts=True)
            cuts = np.flatnonzero(np.diff(met // size)) + 1
            for at, many in zip(np.split(met, cuts), np.split(n, cuts), strict=True):
                twice = (at % size).astype(np.int32) * 2 + (many > 1)
                yield pa.RecordBatch.from_arrays([pa.array([int(at[0] // size)], pa.int32()), pa.array([twice.astype(np.int32).tobytes()], pa.binary())], ["shard", "met"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, met in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(met.as_buffer(), np.int32)
                held = sums.setdefault(shard, np.zeros(size, np.uint8))
                at = got >> 1
                held[at] = np.minimum(held[at] + 1 + (got & 1), 2)  # a place stands once in a piece
        for shard, held in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.packbits(held > 1).tobytes()], pa.binary())], ["shard", "bits"])

    pieces = digests.select("h").mapInArrow(places, "shard int, met binary")
    found = np.zeros(counters // 8, np.uint8)
    for r in pieces.repartition("shard").mapInArrow(merged, "shard int, bits binary").collect():
        found[r.shard * size // 8 : (r.shard + 1) * size // 8] = np.frombuffer(r.bits, np.uint8)
    return found


def may_repeat(digests: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """False only where a digest's text surely stands once: one of its counters met a single row."""
    at = sketch_places(digests, len(sketch) * 8)
    return ((sketch[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


def first_copies(docs: DataFrame, id_col: str, text_col: str, most_counters: int = 1 << 28) -> tuple[DataFrame, Column]:
    """Rows (``first_id``, ``first_digest``) of the smallest id of every text that may stand more than once, and a column of ``docs`` that tells whether its text may.

    The sketch has sixteen counters for every row, up to ``most_counters`` (its bits are
    that / 8 bytes, broadcast); beyond 16 million rows it fills and clears fewer unique texts, which
    costs shuffle and no correctness. Only texts that may repeat are shuffled, whole, and
    combined before that, so a text of very many copies is one row of each task.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.xxhash64(text)
    counters = sketch_size(docs.count(), most_counters)
    sent = docs.sparkSession.sparkContext.broadcast(duplicate_sketch(docs.select(digest.alias("h")), counters))

    @F.pandas_udf("boolean")
    def repeated(h: pd.Series) -> pd.Series:
        return pd.Series(may_repeat(h.to_numpy(np.int64), sent.value))

    possible = repeated(digest)
    least = docs.where(possible).groupBy(text.alias("_text")).agg(F.min(F.col(f"`{id_col}`")).alias("first_id"))
    return least.select("first_id", F.sha2(F.col("_text").cast("binary"), 256).alias("first_digest")), possible


def own_failures(text_col: str) -> dict[str, Column]:
    """Filters A to D, each a failure condition on one text; null counts as empty."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return {
        "A": F.size("_words") < 200,
        "B": 100 * F.size(F.array_distinct("_words")) < 50 * F.size("_words"),
        "C": 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def words_in(text_col: str) -> Column:
    """Maximal runs of other characters than the space and the five control characters that break lines or columns."""
    return F.filter(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def failure_masks(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", most_counters: int = 1 << 28
) -> DataFrame:
    """``(part, mask, n, good, toxic)``: how many documents of a part fail exactly the filters of ``mask`` (A is bit 0), and how many of these are labelled.

    E fails where a smaller id has the same text; null ids neither fail E nor count as
    smaller, nor have they labels; rows of one id and text both stand. A document is good, or toxic, if any of its labels says 1.
    """
    firsts, possible = first_copies(docs, id_col, text_col, most_counters)
    raw = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    flags = docs.withColumn("_words", words_in(text_col)).select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(own_failures(text_col).values())), F.lit(0)).alias("own"),
        F.when(possible, F.sha2(raw, 256)).alias("digest"),
    )
    flags = checkpointed(flags)
    cleared = flags.where("digest is null or id is null").select("id", "part", F.col("own").alias("mask"))
    repeat = flags.where("digest is not null and id is not null").groupBy("id", "part", "own", "digest").agg(F.count("*").alias("times"))
    # by id and digest, so that the copies of one text are no hot key
    known = repeat.join(firsts, (F.col("id") == F.col("first_id")) & (F.col("digest") == F.col("first_digest")), "left")
    copied = known.select("id", "part", (F.col("own") + F.when(F.col("first_id").isNull(), 16).otherwise(0)).alias("mask"), "times")
    judged = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max(F.expr("quality = 1")), F.lit(False)).alias("good"), F.coalesce(F.max(F.expr("toxic = 1")), F.lit(False)).alias("toxic"))
    every = cleared.withColumn("times", F.lit(1).cast("long")).unionByName(copied).join(judged, F.col("id") == F.col("doc_id"), "left")
    held = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("times"))), F.lit(0).cast("long")).alias(c)
    return every.groupBy("part", "mask").agg(F.sum("times").alias("n"), held("good"), held("toxic"))


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, the filter's bit, the bits of those before it) of every order of the filters."""
    found = []
    for order in itertools.permutations(range(len(FILTERS))):
        for k, f in enumerate(order):
            found.append(("".join(FILTERS[i] for i in order), k + 1, 1 << f, sum(1 << i for i in order[:k])))
    return found


def audit_orders(masks: DataFrame) -> DataFrame:
    """Counts of every part, order and step from the counts of masks; each part becomes one row of 32 counters first.

    A document that fails ``m`` filters is removed by each of them in 1 / m of all orders.
    """
    size = 1 << len(FILTERS)
    sums = [F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0).cast("long")) for c in ("n", "good", "toxic") for m in range(size)]
    parts = masks.groupBy("part").agg(*[F.array(*sums[k * size : (k + 1) * size]).alias(c) for k, c in enumerate(("n", "good", "toxic"))])
    plan = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(s).alias("s"), F.lit(f).alias("f"), F.lit(b).alias("b")) for o, s, f, b in steps()])
    shares = [math.factorial(len(FILTERS)) // max(m.bit_count(), 1) for m in range(size)]
    each = F.sequence(F.lit(0), F.lit(size - 1))
    zero = F.lit(0).cast("long")

    def total(counts: str, test, weight=None) -> Column:
        weigh = lambda m: F.get(F.col(counts), m) * (F.get(F.array(*[F.lit(w).cast("long") for w in weight]), m) if weight else F.lit(1).cast("long"))
        return F.aggregate(each, zero, lambda n, m: n + F.when(test(m), weigh(m)).otherwise(zero))

    own, prior = F.col("p.f"), F.col("p.b")
    fails = lambda m: m.bitwiseAND(own) != 0
    gone = lambda m: m.bitwiseAND(prior) != 0
    return parts.select("*", F.explode(plan).alias("p")).select(
        "part",
        F.col("p.o").alias("filter_order"),
        F.col("p.s").alias("step"),
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("n", lambda m: fails(m) & ~gone(m)).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        F.get("n", own).alias("unique_fails"),
        total("good", lambda m: fails(m) & ~gone(m)).alias("good_lost"),
        total("toxic", lambda m: fails(m) & ~gone(m)).alias("toxic_lost"),
        total("n", fails, shares).alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """One row for every part, order and step, zeros included: see ``failure_masks`` and ``audit_orders``.

    Null texts are empty, null parts are the part named by the empty text, an empty table has no part; other columns have no effect.
    """
    return audit_orders(failure_masks(docs, labels, **columns))


def oracle() -> str:
    """The same rows in DuckDB SQL; Shapley sums are taken over the orders themselves."""
    return r"""
        with recursive t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
        w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from t),
        f as (select doc_id, part, len(w) < 200 as fa, 100 * len(list_distinct(w)) < 50 * len(w) as fb, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) as fc,
          regexp_matches(text, '[#$%&*|]') as fd, coalesce(doc_id > min(doc_id) over (partition by text), false) as fe from w),
        l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
        d as (select part, fa::int + 2 * fb::int + 4 * fc::int + 8 * fd::int + 16 * fe::int as mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
          from f left join l using (doc_id) group by all),
        p as (select '' as o union all select o || x from p, (select unnest(['A', 'B', 'C', 'D', 'E']) as x) where not contains(o, x)),
        s as (select o as filter_order, step::int as step, (1 << (ascii(o[step]) - 65))::int as own, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(o[i]) - 65))), 0)::int as prior
          from p, range(1, 6) r(step) where length(o) = 5),
        g as (select q.part, filter_order, step, own, prior, n, good, toxic, mask & own <> 0 as fails, mask & prior <> 0 as gone, mask = own as alone from (select distinct part from d) q, s left join d on d.part = q.part),
        c as (select part, filter_order, step, own, coalesce(sum(n) filter (not fails and not gone), 0)::bigint as kept, coalesce(sum(n) filter (fails and not gone), 0)::bigint as removed,
          coalesce(sum(n) filter (fails and gone), 0)::bigint as redundant, coalesce(sum(n) filter (alone), 0)::bigint as unique_fails,
          coalesce(sum(good) filter (fails and not gone), 0)::bigint as good_lost, coalesce(sum(toxic) filter (fails and not gone), 0)::bigint as toxic_lost from g group by all)
        select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from c
    """
