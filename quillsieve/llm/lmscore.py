"""Cross-entropy difference of matched target and background bigram models over one shared vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillsieve.llm.common import checkpointed, materialised, text_bytes

_ONE = np.uint64(1)
#: Stands before the first and after the last word of each text; no word has this digest's input.
_EDGE = xxhash.xxh64_intdigest(b"", 7)


def words_of(raw: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, without punctuation at their ends."""
    return [x for w in raw.lower().split() if (x := w.strip(b".,;:!?\"'()[]"))]


class _Numbers(dict):
    """Numbers words in the order of their first look-up."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def packed(values: np.ndarray) -> bytes:
    """8-byte numbers as compressed byte planes."""
    return zstandard.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def _times(keys: np.ndarray) -> np.ndarray:
    """How often each key stands among all."""
    _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[at]


def model_losses(n_pair: np.ndarray, n_before: np.ndarray, n_word: np.ndarray, places: np.ndarray, words: int, prior: float) -> np.ndarray:
    """-log of (c(u v) + prior p(v)) / (c(u) + prior), with p(v) = (c(v) + 1) / (places + words)."""
    return -np.log((n_pair + prior * (n_word + 1) / (places + words)) / (n_before + prior))


@dataclass
class Block:
    """Some texts as numbers of their own words, with the distinct keys that the models count.

    A key is a 64-bit digest: odd for a word (or the edge), even for a pair of neighbours.
    ``keys`` are sorted; ``n`` and ``n_target`` count them in all and in the target texts.
    ``copies`` and ``target_copies`` tell how many rows, and target rows, of the corpus have a text.
    """

    words: np.ndarray
    tokens: np.ndarray
    sizes: np.ndarray
    target: np.ndarray
    copies: np.ndarray
    target_copies: np.ndarray

    def __post_init__(self):
        self.size = self.sizes[self.sizes > 0]
        edge = len(self.words)
        before = np.insert(self.tokens.astype(np.int64), np.cumsum(self.size) - self.size, edge)
        after = np.append(before[1:], edge)[: len(before)]
        own = np.repeat(self.target[self.sizes > 0], self.size + 1)
        self.before = before
        self.pairs, self.pair_at = np.unique(before * (edge + 1) + after, return_inverse=True)
        digest = np.append(self.words, np.uint64(_EDGE))
        self.first, self.second = self.pairs // (edge + 1), self.pairs % (edge + 1)
        mixed = (digest[self.first] ^ (digest[self.first] >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + digest[self.second]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        keys = np.concatenate((digest | _ONE, mixed & ~_ONE)) if len(before) else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.place = keys[order], np.empty(len(keys), np.int64)
        self.place[order] = np.arange(len(keys))
        self.n, self.n_target = (
            np.concatenate((np.bincount(b, minlength=edge + 1), np.bincount(p, minlength=len(self.pairs))))[order] if len(before) else np.zeros(0, np.int64)
            for b, p in ((before, self.pair_at), (before[own], self.pair_at[own]))
        )

    @classmethod
    def of(cls, row: dict) -> Block:
        sizes, target = np.array(row["sizes"], np.int64), np.array(row["target"], bool)
        copies = (np.array(row[k], np.int64) for k in ("copies", "target_copies"))
        return cls(unpacked(row["words"]), np.frombuffer(zstandard.decompress(row["tokens"]), np.uint32), sizes, target, *copies)

    def mean_losses(self, n: np.ndarray, n_target: np.ndarray, places: int, target_places: int, words: int, prior: float) -> tuple[np.ndarray, np.ndarray]:
        """(target, background) of each text, over its words and its end; NaN without words.

        ``n`` and ``n_target`` are the corpus's counts of ``keys``, from which all copies of
        the text itself are taken. What is left of the background then counts in the
        proportion that makes it as large as what is left of the target.
        """
        found = np.full((2, len(self.sizes)), np.nan)
        if not len(self.size):
            return found[0], found[1]
        some, edge = self.sizes > 0, len(self.words)
        doc = np.repeat(np.arange(len(self.size)), self.size + 1)
        starts = np.cumsum(self.size + 1) - (self.size + 1)
        own_pair, own_before = _times(doc * len(self.pairs) + self.pair_at), _times(doc * (edge + 1) + self.before)
        own_word = np.append(own_before[1:], 0)
        own_word[starts + self.size] = own_before[starts]
        rest = np.array([target_places - self.target_copies[some] * (self.size + 1), places - self.copies[some] * (self.size + 1)], np.float64)
        scale = (np.ones(len(self.size)), np.divide(rest[0], rest[1], out=np.zeros(len(self.size)), where=rest[1] > 0))
        for k, (counts, copies) in enumerate(((n_target, self.target_copies), (n, self.copies))):
            every = counts[self.place].astype(np.float64)
            single, pair = every[: edge + 1], every[edge + 1 :]
            left, weight = copies[some][doc], scale[k][doc]
            loss = model_losses(
                weight * (pair[self.pair_at] - left * own_pair),
                weight * (single[self.first[self.pair_at]] - left * own_before),
                weight * (single[self.second[self.pair_at]] - left * own_word),
                rest[0][doc], words, prior,
            )
            found[k, some] = np.add.reduceat(loss, starts) / (self.size + 1)
        return found[0], found[1]


#: The columns that make a ``Block``.
_TEXTS = ("target", "copies", "target_copies", "sizes", "words", "tokens")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, as a row is a whole block."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _blocks(batches: Iterator[pa.RecordBatch], partition: int, ident: pa.DataType, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of (id, target, copies, target_copies, raw) as one row for each block of texts."""
    number, made, size = _Numbers(), 0, 0
    ids: list = []
    target: list[bool] = []
    copies: tuple[list[int], list[int]] = [], []
    tokens: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        sizes = [len(x) for x in tokens]
        digests = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in number), np.uint64, len(number))
        places = [n + 1 if n else 0 for n in sizes]
        row = {
            "block": pa.array([partition << 32 | made], pa.int64()),
            "places": pa.array([sum(places)], pa.int64()),
            "target_places": pa.array([sum(n for n, t in zip(places, target, strict=True) if t)], pa.int64()),
            "ids": pa.array([ids], pa.list_(ident)),
            "target": pa.array([target], pa.list_(pa.bool_())),
            "copies": pa.array([copies[0]], pa.list_(pa.int64())),
            "target_copies": pa.array([copies[1]], pa.list_(pa.int64())),
            "sizes": pa.array([sizes], pa.list_(pa.int32())),
            "words": pa.array([packed(digests)], pa.binary()),
            "tokens": pa.array([zstandard.compress(np.concatenate(tokens).tobytes(), 1)], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(row)

    for batch in batches:
        for i, t, c, own, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
            raw = raw.as_py()
            ids.append(i)
            target.append(t)
            copies[0].append(c)
            copies[1].append(own)
            tokens.append(np.array(list(map(number.__getitem__, words_of(raw))), np.uint32))
            size += len(raw) + 16
            if size >= block_bytes:
                yield out()
                made, size = made + 1, 0
                for x in (number, ids, target, *copies, tokens):
                    x.clear()
    if ids:
        yield out()


def _requests(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The keys of each block with its counts, a row for each bucket of keys."""
    for row in _each(batches):
        own = Block.of(row)
        bucket = (own.keys >> np.uint64(64 - bits)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else [0]
        spans = list(zip(cuts, cuts[1:], strict=False))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int(bucket[a]) for a, _ in spans], pa.int64()),
                pa.array([row["block"]] * len(spans), pa.int64()),
                pa.array([packed(np.diff(own.keys[a:b], prepend=np.uint64(0))) for a, b in spans], pa.binary()),
                pa.array([packed(own.n[a:b]) for a, b in spans], pa.binary()),
                pa.array([packed(own.n_target[a:b]) for a, b in spans], pa.binary()),
            ],
            ["bucket", "block", "keys", "n", "n_target"],
        )


def _answers(bucket: pa.Table) -> pa.Table:
    """Sums the counts of a bucket's keys over all blocks and hands each block the sums of its own keys."""
    keys = [np.cumsum(unpacked(x.as_py()), dtype=np.uint64) for x in bucket.column("keys")]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    ends = np.cumsum([len(k) for k in keys])
    sums = []
    for name in ("n", "n_target"):
        counts = np.concatenate([unpacked(x.as_py()) for x in bucket.column(name)]).astype(np.float64)  # whole below 2**53
        total = np.bincount(at, weights=counts, minlength=len(every)).astype(np.uint64)[at]
        sums.append(pa.array([packed(x) for x in np.split(total, ends[:-1])], pa.binary()))
    words = [int((every & _ONE).sum())] + [0] * (len(keys) - 1)
    return pa.table([bucket.column("block"), bucket.column("bucket"), *sums, pa.array(words, pa.int64())], ["block", "bucket", "n", "n_target", "words"])


def _with_copies(rows: DataFrame, most_broadcast: int, salts: int = 16) -> DataFrame:
    """``rows`` (id, target, raw) with ``copies`` and ``target_copies``, the rows and the target rows of the same text.

    Only digests of the texts that stand more than once are joined: broadcast up to
    ``most_broadcast`` of them, else under every one of ``salts``, so that no task gets all copies of a text.
    """
    digest = F.md5("raw")
    several = rows.where(F.octet_length("raw") > 0).groupBy(digest.alias("d")).agg(F.count("*").alias("n"), F.count_if("target").alias("n_target"))
    several = checkpointed(several.where("n > 1"))
    keyed = rows.withColumns({"digest": digest, "salt": F.lit(0)})
    if several.limit(most_broadcast + 1).count() <= most_broadcast:
        several = F.broadcast(several.withColumn("s", F.lit(0)))
    else:
        keyed = keyed.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        several = several.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = keyed.join(several, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    counts = F.coalesce("n", F.lit(1)).alias("copies"), F.coalesce("n_target", F.col("target").cast("long")).alias("target_copies")
    return found.select("id", "target", *counts, "raw")


def cross_entropy_difference(
    docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: float = 50.0,
    block_bytes: int = 8_000_000, bucket_keys: int = 1_000_000, most_broadcast: int = 1_000_000,
) -> DataFrame:
    """One row per document: id, ``n_tokens``, ``target_loss``, ``background_loss`` and their difference ``score``.

    ``targets`` has the ids (column ``id_col``) of the documents that the target model
    counts; the background model counts all. Both share the vocabulary of every word of
    the corpus, the order, the smoothing and the size: counts of the background weigh as
    many times less as the background is larger, which are the expected counts of a sample
    as large as the target. A text is scored by models that leave out all rows of just this
    text, so a target and its unlabelled copy score alike. Losses are means over a text's
    words and its end. The lower the score, the more a text is like the target.

    The models are tables of counts as large as the corpus makes them; none is collected or
    broadcast. Texts are numbered in blocks of ``block_bytes``; a block sends each of its
    distinct words and pairs once, to buckets of about ``bucket_keys`` of them, where they
    are summed, and gets the sums back. So the most frequent word or pair costs a row's
    entry for each block, not for each place. Keys are 64-bit digests.

    Texts without words have no tokens and null losses; null ids never are targets; an empty
    ``targets``, or none but the text itself, gives two uniform models and a score of zero.
    Repeated rows keep a row each. The target ids, and the digests of repeated texts,
    are broadcast up to ``most_broadcast`` of them and joined by a shuffle beyond that.
    """
    wanted = targets.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("t_id")).distinct()
    wanted = F.broadcast(wanted) if wanted.limit(most_broadcast + 1).count() <= most_broadcast else wanted
    rows = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("raw")).join(wanted, F.col("id") == F.col("t_id"), "left")
    rows = _with_copies(rows.select("id", F.col("t_id").isNotNull().alias("target"), "raw"), most_broadcast)
    ident, id_type = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(batches, TaskContext.get().partitionId(), id_type, block_bytes)

    blocks = materialised(
        rows.mapInArrow(
            numbered,
            f"block long, places long, target_places long, ids array<{ident}>, target array<boolean>, copies array<long>, target_copies array<long>, sizes array<int>, words binary, tokens binary",
        )
    )
    whole = blocks.agg(F.coalesce(F.sum("places"), F.lit(0)).alias("n"), F.coalesce(F.sum("target_places"), F.lit(0)).alias("n_target")).first()
    bits = max(8, (2 * whole.n // bucket_keys).bit_length())
    asked = blocks.select("block", *_TEXTS).mapInArrow(
        lambda b: _requests(b, bits), "bucket long, block long, keys binary, n binary, n_target binary"
    )
    answers = materialised(asked.groupBy("bucket").applyInArrow(_answers, "block long, bucket long, n binary, n_target binary, words long"))
    words = answers.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n")).first().n

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            own = Block.of(row)
            got = sorted(row["answers"] or [], key=lambda x: x["bucket"])
            n, n_target = (np.concatenate([unpacked(x[k]) for x in got]) if got else np.zeros(0) for k in ("n", "n_target"))
            loss = [pa.array(x, mask=np.isnan(x)) for x in own.mean_losses(n, n_target, whole.n, whole.n_target, words, prior)]
            ids = pa.array(row["ids"], id_type)
            yield pa.RecordBatch.from_arrays([ids, pa.array(own.sizes), *loss], ["id", "n_tokens", "target_loss", "background_loss"])

    sent = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "n_target")).alias("answers"))
    found = blocks.join(sent, "block", "left").select("ids", *_TEXTS, "answers")
    found = found.mapInArrow(scored, f"id {ident}, n_tokens long, target_loss double, background_loss double")
    return found.select(
        F.col("id").alias(id_col), "n_tokens", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score")
    )
