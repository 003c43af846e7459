"""Language identification by the nearest of several centroids per language, over normalised TF-IDF vectors of character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import checkpointed, kept_columns, quoted

UNKNOWN = "und"
_BLOCK = 1 << 16
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
#: Texts of fewer letters than these are judged by radii of their own: short texts lie farther from every centroid.
_BANDS = (32, 128, 512)


def gram_counts(text: str, dims: int, longest: int = 3) -> np.ndarray | None:
    """How often each hashed n-gram of 1 to ``longest`` letters stands in the lower-cased text, word ends included; none without a letter.

    Long texts are counted in blocks of ``_BLOCK`` characters that overlap, so memory does not grow with the text.
    """
    if not _LETTER.search(text):
        return None
    line = " " + _OTHER.sub(" ", text.lower()).strip() + " "
    counts = np.zeros(dims, np.int64)
    for at in range(0, len(line), _BLOCK):
        some = np.frombuffer(line[at : at + _BLOCK + longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        own = min(_BLOCK, len(line) - at)
        rolled = np.zeros(len(some), np.uint64)
        for n in range(1, longest + 1):
            if len(some) < n:
                break
            rolled = (rolled[: len(some) - n + 1] * np.uint64(0x100000001B3) + some[n - 1 :] + np.uint64(n)) & np.uint64((1 << 56) - 1)
            mixed = (rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            counts += np.bincount((mixed % np.uint64(dims)).astype(np.int64)[:own], minlength=dims)
    return counts


def weighed(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places and values of a text's TF-IDF vector of length one; roots of counts damp long texts."""
    at = np.flatnonzero(counts)
    value = np.sqrt(counts[at]) * idf[at]
    size = math.sqrt(float(value @ value))
    return at, value / size if size else value


@dataclass
class LanguageModel:
    """Inverse document frequencies, centroids of length one with their languages, and the radius of its language for every band of lengths."""

    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    radii: np.ndarray
    longest: int = 3

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language of the nearest centroid, the cosine with it, and whether it is farther than its language's radius."""
        counts = gram_counts(text, len(self.idf), self.longest) if text else None
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, True
        at, value = weighed(counts, self.idf)
        cosines = self.centroids[:, at] @ value
        best = int(np.argmax(cosines))
        score = min(max(float(cosines[best]), 0.0), 1.0)
        return self.languages[best], score, 1 - score > self.radii[best, band(text)]


def band(text: str) -> int:
    return int(np.searchsorted(_BANDS, len(text), side="right"))


def _document_counts(texts: DataFrame, dims: int, longest: int) -> tuple[np.ndarray, int]:
    """In how many texts each n-gram stands, over all of them: a vector of fixed size from each task, summed on Spark."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            for x in batch.column(0):
                counts = gram_counts(x.as_py() or "", dims, longest)
                if counts is not None:
                    held += counts > 0
                    n += 1
        if n:
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(held[at], n), pa.int64())], ["gram", "n"])

    got = texts.mapInArrow(counted, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(dims + 1, np.int64)
    counts[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    return counts[:dims], int(counts[dims])


def cluster_directions(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of rows of length one: centroids of length one and each row's; starts are the farthest from those before."""
    starts = [int(np.argmax(vectors @ vectors.mean(axis=0)))]
    best = vectors @ vectors[starts[0]]
    while len(starts) < min(k, len(vectors)):
        starts.append(int(np.argmin(best)))
        best = np.maximum(best, vectors @ vectors[starts[-1]])
    centroids = vectors[starts].copy()
    for _ in range(rounds):
        own = np.argmax(vectors @ centroids.T, axis=1)
        for c in range(len(centroids)):
            mine = vectors[own == c]
            if len(mine):
                centroids[c] = mine.mean(axis=0)
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return centroids, np.argmax(vectors @ centroids.T, axis=1)


def _radii(distances: np.ndarray, bands: np.ndarray, share: float, slack: float) -> np.ndarray:
    """For each band of lengths, the distance that ``share`` of the rows keep, times ``slack``; a band of under 20 rows takes the shorter band's, or all rows'."""
    before = np.quantile(distances, share) if len(distances) else 1.0
    found = []
    for b in range(len(_BANDS) + 1):
        rows = distances[bands == b]
        before = np.quantile(rows, share) if len(rows) >= 20 else before
        found.append(before * slack)
    return np.array(found)


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dims: int = 8192, longest: int = 3, centroids: int = 4, sample: int = 1200,
    share: float = 0.995, slack: float = 1.15, most_bytes: int = 256 << 20,
) -> LanguageModel:
    """Learns from rows of non-null language and text.

    Document frequencies count every row. The centroids of a language come from about
    ``sample`` of its rows at most, chosen by a hash of text and id; each language is a task that
    holds ``sample`` vectors of ``dims`` numbers. A quarter of these draws no centroid and sets the
    language's radii, one for each band of lengths. Models beyond ``most_bytes`` raise.
    """
    spark = docs.sparkSession
    known = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    rows_of = {r.lang: r.n for r in sizes.limit(most_bytes // (dims * 4 * centroids) + 1).collect()}
    if len(rows_of) * dims * 4 * centroids > most_bytes:
        raise ValueError(f"more languages than {most_bytes} bytes of centroids hold")
    seen, n = _document_counts(known.select("text"), dims, longest)
    idf = np.log((1 + n) / (1 + seen)) + 1
    part = F.pmod(F.xxhash64("text", "id"), F.lit(1 << 30))
    share_of = F.broadcast(spark.createDataFrame([(lang, int(min(1.0, sample / many) * (1 << 30))) for lang, many in rows_of.items()], "lang string, below long"))
    drawn = known.join(share_of, "lang").where(part < F.col("below")).select("lang", "text")
    sent = spark.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                counts = gram_counts(text.as_py(), dims, longest)
                if counts is not None:
                    at, value = weighed(counts, sent.value)
                    made = [pa.array([lang.as_py()]), pa.array([band(text.as_py())], pa.int32()), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([value.astype(np.float32)], pa.list_(pa.float32()))]
                    yield pa.RecordBatch.from_arrays(made, ["lang", "band", "at", "value"])

    def clustered(rows: pa.Table) -> pa.Table:
        x = np.zeros((rows.num_rows, dims), np.float32)
        for k, (at, value) in enumerate(zip(rows.column("at").to_pylist(), rows.column("value").to_pylist(), strict=True)):
            x[k, at] = value
        order = np.lexsort(x[:, : min(dims, 64)].T)  # rows come in any order, the result should not
        x, bands = x[order], rows.column("band").to_numpy()[order]
        apart = np.arange(len(x)) % 4 == 3 if len(x) >= 80 else np.ones(len(x), bool)  # rows that draw no centroid to them tell how far others lie
        found = cluster_directions(x[~apart] if not apart.all() else x, centroids)[0]
        radii = _radii(1 - (x[apart] @ found.T).max(axis=1).astype(float), bands[apart], share, slack)
        return pa.table({"lang": [rows.column("lang")[0].as_py()] * len(found), "centroid": list(found), "radii": [radii] * len(found)})

    made = drawn.mapInArrow(vectors, "lang string, band int, at array<int>, value array<float>").groupBy("lang").applyInArrow(clustered, "lang string, centroid array<float>, radii array<double>")
    got = checkpointed(made).orderBy("lang").toArrow()
    if not got.num_rows:
        return LanguageModel(idf, [], np.zeros((0, dims), np.float32), np.zeros((0, len(_BANDS) + 1)), longest)
    return LanguageModel(
        idf, got.column("lang").to_pylist(), np.array(got.column("centroid").to_pylist(), np.float32), np.array(got.column("radii").to_pylist()), longest
    )


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None, reject: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (the cosine, 0 to 1) and ``rejected``.

    ``rejected`` is true where the text lies beyond the radius around its nearest centroid; with
    ``reject`` such a text is ``und``. A null text, or one without a letter, is ``und`` with
    score 0, as is every text under a model of no language. Nearest is the first of equal
    centroids in the order of languages. Repeated rows are judged alike; columns named as the
    made ones are replaced.
    """
    made = ("lang_pred", "score", "rejected")
    kept = kept_columns(docs, keep, made)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index(text_col)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.predict(x.as_py()) for x in batch.column(len(kept))]
            langs = [UNKNOWN if reject and far else lang for lang, _, far in found]
            columns = [*batch.columns[: len(kept)], pa.array(langs, pa.string()), pa.array([s for _, s, _ in found], pa.float64()), pa.array([bool(far) for _, _, far in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *made])

    fields = [docs.schema[c] for c in kept]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string", "score double", "rejected boolean"])
    return docs.select(*quoted(kept), F.col(f"`{docs.columns[text]}`").alias("_text")).mapInArrow(predicted, schema)
