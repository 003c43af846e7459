"""SimHash near-duplicates by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import checkpointed, complete_runs, text_bytes
from quillsieve.llm.graph import connected_components

_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of the text's word shingles; 0 for a text without words."""
    parts = text.lower().split()
    n = len(parts)
    if n == 0:
        return 0
    if n < words:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(parts), seed)], dtype=np.uint64)
    else:
        line = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(line[a:b], seed) for a, b in spans), np.uint64, n - words + 1)
    return majority_bits(hashes)


def majority_bits(hashes: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half the hashes; 0 for none."""
    lanes = np.ascontiguousarray(hashes.astype(">u8")).view(np.uint8).reshape(-1, 8)
    set_bits = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BIT_OF_BYTE for k in range(8)])
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def _expand(v: np.ndarray, depth: int, nodes: np.ndarray, budget: int) -> np.ndarray:
    """The child pairs of trie node pairs at ``depth``; a node is a range of the sorted values ``v``."""
    a0, a2, b0, b2, diff = nodes
    ones = np.concatenate(([0], np.cumsum((v >> np.uint64(63 - depth)) & np.uint64(1)))).astype(np.int64)
    a1, b1 = a2 - (ones[a2] - ones[a0]), b2 - (ones[b2] - ones[b0])
    other = (a0 != b0) | (a2 != b2)
    out = np.concatenate(
        [
            np.stack([a0, a1, b0, b1, diff]),
            np.stack([a1, a2, b1, b2, diff]),
            np.stack([a0, a1, b1, b2, diff + 1]),
            np.stack([a1, a2, b0, b1, diff + 1])[:, other],
        ],
        axis=1,
    )
    return out[:, (out[0] < out[1]) & (out[2] < out[3]) & (out[4] <= budget)]


def _leaf_links(v: np.ndarray, nodes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    a0, a2, b0, b2, _ = nodes
    wide = b2 - b0
    count = (a2 - a0) * wide
    first = np.repeat(np.cumsum(count) - count, count)
    k = np.arange(len(first)) - first
    wide = np.repeat(wide, count)
    i, j = np.repeat(a0, count) + k // wide, np.repeat(b0, count) + k % wide
    keep = (i != j) & (np.bitwise_count(v[i] ^ v[j]) <= budget)
    return i[keep], j[keep]


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after the links; ``label`` points every value at its root."""
    while len(i):
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def trie_components(v: np.ndarray, roots: np.ndarray, budget: int, depth: int = 0, leaf: int = 256, most: int = 200_000) -> np.ndarray:
    """Walks pairs of trie nodes together and returns for each sorted value the first value it is linked to.

    ``roots`` holds one column (a0, a2, b0, b2, bits that differ) a root pair. Pairs
    whose bits differ more than ``budget`` are pruned; small ones are compared outright.
    """
    label = np.arange(len(v))
    stack = [(depth, roots)]
    while stack:
        depth, nodes = stack.pop()
        if nodes.shape[1] > most:
            half = nodes.shape[1] // 2
            stack += [(depth, nodes[:, half:]), (depth, nodes[:, :half])]
            continue
        work = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2])
        small = (work <= leaf) if depth < 64 else np.ones(len(work), bool)
        if small.any():
            label = _merge(label, *_leaf_links(v, nodes[:, small], budget))
        if not small.all():
            below = _expand(v, depth, nodes[:, ~small], budget)
            if below.shape[1]:
                stack.append((depth + 1, below))
    return label


def _linked(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    for run in complete_runs(batches, "task"):
        task, side = run.column("task").to_numpy(), run.column("side").to_numpy()
        v, fp = run.column("turned").to_numpy().view(np.uint64), run.column("fp").to_numpy()
        order = np.lexsort((v, side, task))
        task, side, v, fp = task[order], side[order], v[order], fp[order]
        start = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1])))
        end = np.concatenate((start[1:], [len(task)]))
        half = np.concatenate(([0], np.cumsum(side == 0)))
        middle = start + half[end] - half[start]
        alone = side[start] == 2
        a2, b0 = np.where(alone, end, middle), np.where(alone, start, middle)
        label = trie_components(v, np.stack([start, a2, b0, end, np.zeros_like(start)])[:, (a2 > start) & (end > b0)], budget)
        other = label != np.arange(len(label))
        yield pa.RecordBatch.from_arrays([pa.array(fp[other]), pa.array(fp[label[other]])], ["src", "dst"])


def fingerprint_links(fps: DataFrame, budget: int = 4, node_rows: int = 1 << 20) -> DataFrame:
    """Links ``(src, dst)`` that connect all distinct values of ``fp`` (long) within ``budget`` differing bits.

    The 64 bits are cut into budget + 1 blocks, of which two linked values share
    at least one whole. Each block in turn leads a rotated trie, whose nodes at
    the block's depth are the tasks. The walk itself prunes, so a node is cut only if it
    has more than ``node_rows`` values, as many as a task holds: then pairs of its subtrees
    within the bit budget become tasks. A value is one row of each trie up to 4 billion
    distinct values, and at most sum(C(c, 0..budget)) rows where nodes are cut c times: 4 of
    each trie at 30 billion. A task returns a spanning forest, never all pairs.
    """
    blocks = budget + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    turned = fps.select(
        "fp",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(k).cast("long").alias("trie"),
                        F.lit(edges[k + 1] - edges[k]).alias("lead"),
                        (
                            F.shiftleft("fp", edges[k]).bitwiseOR(F.shiftrightunsigned("fp", 64 - edges[k])) if k else F.col("fp")
                        ).alias("turned"),
                    )
                    for k in range(blocks)
                ]
            )
        ).alias("t"),
    ).select("fp", "t.*")
    turned = turned.withColumn(
        "node", F.col("trie") * (1 << 36) + F.expr("shiftrightunsigned(turned, 64 - lead)")
    )
    crowded = (
        turned.groupBy("node").count().where(F.col("count") > node_rows)
        .select("node", F.least(F.lit(10), F.ceil(F.log2(F.col("count") / node_rows))).cast("int").alias("cut"))
    )
    below = F.expr("shiftrightunsigned(shiftleft(turned, lead), 64 - cut)")
    tasks = (
        turned.join(crowded, "node", "left")
        .withColumn("cut", F.coalesce("cut", F.lit(0)))
        .withColumn("p", F.when(F.col("cut") > 0, below).otherwise(F.lit(0)).cast("long"))
        .withColumn(
            "q",
            F.explode(
                F.when(
                    F.col("cut") > 0,
                    F.expr(f"filter(sequence(0L, shiftleft(1L, cut) - 1), q -> bit_count(q ^ p) <= {budget})"),
                ).otherwise(F.array(F.lit(0).cast("long")))
            ),
        )
        .select(
            "fp",
            "turned",
            (F.col("node") * (1 << 20) + F.least("p", "q") * 1024 + F.greatest("p", "q")).alias("task"),
            F.when(F.col("p") == F.col("q"), 2).when(F.col("p") < F.col("q"), 0).otherwise(1).cast("byte").alias("side"),
        )
    )
    spread = tasks.repartition("task").sortWithinPartitions("task")
    return spread.mapInArrow(lambda batches: _linked(batches, budget), "src long, dst long")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, budget: int = 4
) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Documents whose fingerprints differ in at most ``budget`` bits are linked;
    ``component_id`` is the smallest id that links reach. A null, empty or blank
    text has fingerprint zero and is linked like any other. Repeated rows keep one
    row each; a null id stays null and takes part in links. Other columns are ignored.
    """
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), words, seed) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    fps = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("raw"))
    fps = checkpointed(fps.mapInArrow(prints, "id long, fp long"))
    distinct = fps.groupBy("fp").agg(F.min("id").alias("rep"))
    member = connected_components(fingerprint_links(distinct, budget))
    member = member.join(distinct, F.col("node") == F.col("fp")).select("fp", "rep", "root")
    smallest = member.groupBy("root").agg(F.min("rep").alias("least_id"))
    found = member.join(smallest, "root").select("fp", "least_id")
    by_print = distinct.join(found, "fp", "left").select("fp", F.coalesce("least_id", "rep").alias("component_id"))
    by_print = checkpointed(by_print)  # so that both sides of the join below are dealt out for it alone, and a print of very many documents is split
    return fps.join(by_print, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the document of the smallest id of each component; rows without an id stay."""
    lead = simhash_components(docs, id_col, text_col, **options).where(F.col(id_col) == F.col("component_id"))
    lead = lead.select(F.col(id_col).alias("_lead_id")).distinct()
    return docs.where(F.col(id_col).isNull()).unionByName(
        docs.join(lead, F.col(id_col).cast("long") == F.col("_lead_id"), "left_semi")
    )
