"""Near-duplicates by the Jaccard similarity of word shingles: links of the SimHash trie, verified, and a prefix-filtered self-join for those that differ in more bits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import checkpointed, discard, materialised, release_shuffles, text_bytes
from quillsieve.llm.graph import connected_components
from quillsieve.llm.simhash import fingerprint_links, majority_bits


def shingles(text: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted different hashes of the text's word shingles; one of the whole text where it has fewer words, none without words."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    many = max(len(parts) - words + 1, 1)
    spans = zip(starts[:many].tolist(), ends[-many:].tolist(), strict=True)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b], seed) for a, b in spans), np.uint64, many))


_BUCKETS = 1 << 20
_PIECE = 1 << 16


def shingle_sketch(docs: DataFrame, words: int) -> np.ndarray:
    """How often the shingles of all texts (id, raw) fall in each of ``_BUCKETS`` buckets: a table of fixed size from every task, summed in pieces on Spark."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(_BUCKETS, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                grams = np.concatenate([shingles(x.as_py(), words) for x in batch.column(1)[k : k + 500]])
                np.add.at(held, (grams % np.uint64(_BUCKETS)).astype(np.int64), 1)
            pa.default_memory_pool().release_unused()
        for k in range(0, _BUCKETS, _PIECE):
            if held[k : k + _PIECE].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([held[k : k + _PIECE].tobytes()], pa.binary())], ["at", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(counts.as_buffer(), np.int64)
        for at, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["at", "counts"])

    found = np.zeros(_BUCKETS, np.int64)
    for r in docs.mapInArrow(counted, "at int, counts binary").repartition("at").mapInArrow(summed, "at int, counts binary").collect():
        found[r["at"] : r["at"] + _PIECE] = np.frombuffer(r["counts"], np.int64)
    return found


def prefix(grams: np.ndarray, sketch: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles in one order of all (those of rare buckets first): texts of ``similarity`` share one of these."""
    n = sketch[(grams % np.uint64(len(sketch))).astype(np.int64)]
    return grams[np.lexsort((grams, n))][: len(grams) - math.ceil(len(grams) * similarity - 1e-9) + 1]


def _alike(pairs: DataFrame, rows: DataFrame, words: int, similarity: float, most_broadcast: int) -> DataFrame:
    """The pairs (src, dst) whose texts in ``rows`` (id, raw) have sets at least that similar; only texts of pairs are cut into sets."""

    def gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                some = batch.slice(k, 1000)
                sets = [shingles(x.as_py(), words).view(np.int64) for x in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "grams"])

    pairs = checkpointed(pairs.distinct())
    ids = checkpointed(pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    ids = F.broadcast(ids) if ids.count() <= most_broadcast else ids
    sets = materialised(rows.join(ids, "id", "left_semi").mapInArrow(gram_sets, "id long, grams array<long>"))
    both = pairs.join(sets.toDF("src", "a"), "src").join(sets.toDF("dst", "b"), "dst")
    shared = F.size(F.array_intersect("a", "b"))
    found = checkpointed(both.where(shared >= similarity * (F.size("a") + F.size("b") - shared) - 1e-9).select("src", "dst"))
    discard(sets)
    return found


def similar_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, budget: int = 4, most_stars: int = 12,
    most_pairs: int = 2, most_broadcast: int = 500_000,
) -> DataFrame:
    """``(node, root)`` of every id that is linked to another one; the root is the smallest id that links reach.

    Texts of equal lower-cased words are linked, as are texts whose ``words``-word shingle
    sets have a Jaccard similarity of ``similarity`` or more. The SimHash trie links texts
    whose fingerprints differ in ``budget`` bits at most, where their sets are that similar.
    Most pairs at the limit differ in more bits, so the others follow by shingles: each such
    pair must share one of both prefixes. The order of shingles comes from counts of the
    whole corpus in a table of fixed size; it moves frequent ones out of the prefixes and has
    no part in the result. Shingles that the same texts share, as those of a quoted passage,
    count as one. While the texts that share one make more than ``most_pairs`` pairs for each
    text, and turns still connect some, all are compared with one of them that has few rarer
    shingles, so that a large group is linked by few pairs; then all pairs that are not connected yet.
    No group of a shingle meets in one task: its rows are counted before they are dealt, and
    joins split them. Null ids link nothing; null, empty and blank texts are copies of each
    other; a text of fewer words is one shingle. Ids of up to ``most_broadcast`` rows are
    broadcast, after a count. Ids must be whole numbers or texts of such; others raise.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("raw"))
    frequent = spark.sparkContext.broadcast(shingle_sketch(rows, words))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                some = batch.slice(k, 1000)
                copy, prints, sizes, probes = [], [], [], []
                for x in some.column(1):
                    raw = x.as_py()
                    grams = shingles(raw, words)
                    copy.append(xxhash.xxh3_128_digest(b" ".join(raw.lower().split())))
                    prints.append(majority_bits(grams))
                    sizes.append(len(grams))
                    probes.append(prefix(grams, frequent.value, similarity).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(copy, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(probes, pa.list_(pa.int64()))],
                    ["id", "copy", "fp", "n", "probes"],
                )
            pa.default_memory_pool().release_unused()

    found = materialised(rows.mapInArrow(prefixes, "id long, copy binary, fp long, n int, probes array<long>"))
    first = found.groupBy("copy").agg(F.min("id").alias("node"))
    links = checkpointed(found.select("id", "copy").join(first, "copy").where("id <> node").select(F.col("id").alias("src"), F.col("node").alias("dst")))
    later = links.select(F.col("src").alias("id"))
    later = F.broadcast(later) if later.count() <= most_broadcast else later
    single = found.join(later, "id", "left_anti")

    prints = checkpointed(single.groupBy("fp").agg(F.min("id").alias("rep"), F.max("id").alias("last")))
    near = checkpointed(fingerprint_links(prints.select("fp"), budget))
    ends = prints.select(F.col("fp").alias("src"), F.col("rep").alias("a")), prints.select(F.col("fp").alias("dst"), F.col("rep").alias("b"))
    pairs = near.join(ends[0], "src").join(ends[1], "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    same = single.select("id", "fp").join(prints.where("rep <> last"), "fp").where("id <> rep").select(F.col("rep").alias("src"), F.col("id").alias("dst"))
    pairs = pairs.unionByName(same).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    links = links.unionByName(_alike(pairs, rows, words, similarity, most_broadcast))

    probes = single.select("id", "n", F.posexplode("probes").alias("pos", "probe"))
    members = [F.sum(F.shiftright(F.xxhash64(F.lit(k), "id"), 31)).alias(f"m{k}") for k in (0, 1)]
    first = F.min(F.struct("id", "pos")).alias("first")
    several = probes.groupBy("probe").agg(first, F.max("id").alias("last"), F.count("*").alias("many"), *members).where("first.id <> last")
    # of the probes that the same texts share, as those of a quoted passage, the first in the order stands for all
    alone = several.groupBy("first.id", "m0", "m1").agg(F.min(F.struct("first.pos", "probe", "many")).alias("p"))
    alone = checkpointed(alone.select("p.probe", "p.many"))
    pairs_left = alone.agg(F.sum(F.col("many").cast("double") * (F.col("many") - 1) / 2)).first()[0] or 0
    alone = F.broadcast(alone.select("probe")) if alone.count() <= most_broadcast else alone.select("probe")
    shared = materialised(probes.join(alone, "probe", "left_semi").select("probe", "id", "n", "pos"))
    enough_pairs = most_pairs * max(single.count(), 1)
    discard(found)
    release_shuffles(spark)
    open_ = _still_open(shared, links)
    for turn in range(most_stars):
        parts = open_.where(_early(similarity)).groupBy("probe", "root").agg(F.count("*").cast("double").alias("m"))
        apart = parts.groupBy("probe").agg(((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("pairs"))
        before, pairs_left = pairs_left, apart.agg(F.sum("pairs")).first()[0] or 0
        if pairs_left <= enough_pairs or (turn > 1 and pairs_left > 0.9 * before):
            break
        # a text with few rarer shingles is close to most of its group; every turn looks in another quarter of them
        turned = F.xxhash64(F.lit(turn), "id")
        hub = F.struct((turned.bitwiseAND(F.lit(3)) != (0 if turn else -1)).alias("later"), "pos", turned.alias("h"), "id", "n", "root")
        hubs = open_.groupBy("probe").agg(F.min(hub).alias("b")).select("probe", "b.id", "b.n", "b.pos", "b.root")
        pairs = open_.alias("a").join(hubs.alias("b"), "probe").where(_may_be_alike(similarity)).select(F.col("a.id").alias("id"), F.col("b.id").alias("hub"))
        pairs = pairs.select(F.least("id", "hub").alias("src"), F.greatest("id", "hub").alias("dst"))
        links = links.unionByName(_alike(pairs, rows, words, similarity, most_broadcast))
        discard(open_)
        open_ = _still_open(shared, links)
        release_shuffles(spark)
    discard(shared)
    # the one of fewer shingles, by id if equal, stands first; it must share an early one
    before = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.id") < F.col("b.id")))
    pairs = open_.where(_early(similarity)).alias("a").join(open_.alias("b"), "probe").where(before & _may_be_alike(similarity))
    pairs = pairs.select(F.least("a.id", "b.id").alias("src"), F.greatest("a.id", "b.id").alias("dst"))
    last = _alike(pairs, rows, words, similarity, most_broadcast)
    discard(open_)
    return connected_components(links.unionByName(last))


def _still_open(shared: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of probes whose texts the links don't connect, each with its component's root."""
    member = connected_components(links).select(F.col("node").alias("id"), F.col("root").alias("r"))
    rooted = shared.join(member, "id", "left").select("probe", "id", "n", "pos", F.coalesce("r", "id").alias("root"))
    still = rooted.groupBy("probe").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("probe")
    return materialised(rooted.join(still, "probe", "left_semi"))


def _early(similarity: float) -> F.Column:
    """Whether a shingle stands so early in a text's order that one of no fewer shingles can be similar and have it as the first that both share."""
    return F.col("pos") <= (1 - similarity) / (1 + similarity) * F.col("n") + 1e-9


def _may_be_alike(similarity: float) -> F.Column:
    """Whether a and b are not connected and their sizes, and what both have from a shared shingle on, allow that similarity.

    The first shared shingle of similar texts always passes.
    """
    size = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * similarity - 1e-9
    left = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    return (F.col("a.root") != F.col("b.root")) & size & (left >= similarity / (1 + similarity) * (F.col("a.n") + F.col("b.n")) - 1e-9)


def keep_one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = 500_000, **options) -> DataFrame:
    """``docs`` with the document of the smallest id of each component; rows without an id stay and link nothing."""
    gone = checkpointed(similar_components(docs, id_col, text_col, **options).where("node <> root").select(F.col("node").alias("_gone_id")))
    gone = F.broadcast(gone) if gone.count() <= most_broadcast else gone
    return docs.join(gone, F.col(id_col).cast("long") == F.col("_gone_id"), "left_anti")
