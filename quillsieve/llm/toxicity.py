"""A toxicity classifier with a counterfactual penalty on identity terms."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import kept_columns, materialised, quoted

# Terms that name groups neutrally, by kind and language; a term is swapped for others of its row.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "african", "arab", "latino"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("disabled", "deaf", "blind", "old", "young"),
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    ("femme", "homme", "fille", "garçon"),
    ("christlich", "muslimisch", "jüdisch", "hinduistisch", "buddhistisch"),
    ("frau", "mann", "mädchen", "junge"),
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"),
    ("mujer", "hombre", "chica", "chico"),
)

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    """The different words of a text and, as ``abcd*``, the beginnings of its longer words, which endings do not hide."""
    words = set(_WORD.findall(text.lower())) if text else set()
    return words | {b for b in map(beginning, words) if b}


def beginning(word: str) -> str | None:
    return word[:4] + "*" if len(word) > 4 else None


def shared_beginnings(text: str | None) -> set[str]:
    """The beginnings that several words of a text have, which stay when one of these is swapped."""
    begun = Counter(beginning(w) for w in set(_WORD.findall(text.lower()))) if text else Counter()
    return {b for b, n in begun.items() if b and n > 1}


@dataclass
class ToxicityModel:
    """Logistic regression over the presence of words; a text's score needs the text alone."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        get = self.weights.get
        z = self.bias + math.fsum(w for w in map(get, self.weights.keys() & words_of(text)) if w)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def fit(
    column: dict[str, int], row: np.ndarray, col: np.ndarray, labels: np.ndarray, ridge: float = 2e-4, penalty: float = 20.0, steps: int = 400, rate: float = 0.1,
    staying: frozenset[tuple[int, int]] = frozenset(),
) -> ToxicityModel:
    """Minimises mean log loss + ridge + ``penalty`` times the mean squared change of the score when a term is swapped.

    ``row`` and ``col`` list which text has which word of ``column``. A text with an identity
    term is compared with itself where the next two terms of the same kind stand instead: with the
    term goes its beginning, unless ``staying`` lists it for the text, and with the other comes its own.
    Without both labels the model scores every text by the rate of label 1.
    """
    y = labels.astype(np.float64)
    n, ones = len(y), float(y.sum())
    rate_of_one = (ones + 0.5) / (n + 1)
    bias = math.log(rate_of_one / (1 - rate_of_one))
    if not 0 < ones < n:
        return ToxicityModel(bias)
    size = len(column)
    held: dict[int, set[int]] = {}
    begun = {column[t]: column.get(beginning(t)) for terms in IDENTITY_TERMS for t in terms if t in column}
    named = np.isin(col, list(begun))
    near = np.isin(col, [*begun, *(b for b in begun.values() if b is not None)]) & np.isin(row, row[named])
    for r, c in zip(row[near].tolist(), col[near].tolist(), strict=True):
        held.setdefault(r, set()).add(c)
    of: list[int] = []  # the text of each swap
    moves: list[tuple[int, int, int]] = []  # (swap, column, sign)
    for terms in IDENTITY_TERMS:
        own = [column[t] for t in terms if t in column]
        for r, present in held.items():
            for k, c in enumerate(own):
                for step in (1, 2):
                    other = own[(k + step) % len(own)]
                    if c in present and other not in present:
                        gone = {c, begun[c]} if (r, begun[c]) not in staying else {c}
                        then = ((present - gone) | {other, begun[other]}) - {None}
                        moves += [(len(of), x, -1) for x in sorted(present - then)] + [(len(of), x, 1) for x in sorted(then - present)]
                        of.append(r)
    text = np.array(of, np.int64)
    swap, moved, sign = (np.array([m[i] for m in moves], np.int64) for i in range(3))
    w, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = bias
    each = np.where(y == 1, 0.5 * n / ones, 0.5 * n / (n - ones))  # both labels weigh the same
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[col], minlength=n) + w[-1]
        score = sigmoid(z)
        error = each * (score - y) / n
        grad = np.zeros(size + 1)
        if len(moves):
            was = score[text]
            now = sigmoid(z[text] + np.bincount(swap, weights=sign * w[moved], minlength=len(text)))
            change = 2 * penalty * (now - was) / len(text)
            up, down = change * now * (1 - now), change * was * (1 - was)
            error = error + np.bincount(text, weights=up - down, minlength=n)
            grad[:-1] += np.bincount(moved, weights=sign * up[swap], minlength=size)
        grad += np.append(np.bincount(col, weights=error[row], minlength=size), error.sum())
        grad[:-1] += ridge * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return ToxicityModel(float(w[-1]), {word: float(w[k]) for word, k in column.items() if abs(w[k]) > 1e-3})


def held_out(id_col: str) -> F.Column:
    """Documents whose labels are never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _word_counts(batches: Iterator[pa.RecordBatch], most: int = 300_000) -> Iterator[pa.RecordBatch]:
    """(word, texts with it, texts of label 1 with it) of a task."""
    seen, toxic = Counter(), Counter()

    def out() -> Iterator[pa.RecordBatch]:
        words = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64()), pa.array([toxic[w] for w in words], pa.int64())],
            ["word", "n", "n_toxic"],
        )
        seen.clear()
        toxic.clear()

    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = words_of(text.as_py())
            seen.update(words)
            if label:
                toxic.update(words)
            if len(seen) > most:
                yield from out()
    yield from out()


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 20_000,
    most_words: int = 4096, least_docs: int = 4, least_contrast: float = 4.0, **options,
) -> ToxicityModel:
    """Fits on about ``sample`` labelled documents, drawn by a hash of the id; held-out ids and null labels are left out.

    The sample's ids have a fixed bound, so they are broadcast to the documents. Words are
    counted on Spark; columns are those of at least ``least_docs`` texts whose document rates
    differ between the labels by ``least_contrast`` standard errors, ``most_words`` of the largest
    at most, and the identity terms. The column numbers of the sample come to the driver.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_l_id")).agg(F.max(label_col).cast("int").alias("_l_label"))
    share = min(1.0, sample / max(known.count(), 1))
    drawn = known.where(F.pmod(F.xxhash64("_l_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = docs.select(F.col(id_col).alias("_d_id"), F.col(text_col).alias("_d_text")).join(
        F.broadcast(drawn), F.col("_d_id") == F.col("_l_id")
    )
    rows = materialised(rows.select("_d_id", "_d_text", "_l_label"))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("_l_label"), F.lit(0)).alias("ones")).first()
    n, ones = total.n, total.ones
    words: list[str] = []
    if 0 < ones < n:
        counts = rows.select("_d_text", "_l_label").mapInArrow(_word_counts, "word string, n long, n_toxic long")
        counts = counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("t")).where(F.col("n") >= least_docs)
        mean = F.col("n") / n
        error = F.sqrt(mean * (1 - mean) * (1 / ones + 1 / (n - ones)) + 1e-9)
        contrast = F.abs(F.col("t") / ones - (F.col("n") - F.col("t")) / (n - ones)) / error
        clear = counts.withColumn("contrast", contrast).where(F.col("contrast") >= least_contrast)
        words = [r.word for r in clear.orderBy(F.desc("contrast"), "word").limit(most_words).collect()]
    column = {w: k for k, w in enumerate(dict.fromkeys([*words, *(t for terms in IDENTITY_TERMS for t in terms)]))}
    shared = docs.sparkSession.sparkContext.broadcast(column)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value
        for batch in batches:
            found = [sorted(get[w] for w in get.keys() & words_of(x.as_py())) for x in batch.column(1)]
            stay = [sorted(get[w] for w in get.keys() & shared_beginnings(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32())), pa.array(stay, pa.list_(pa.int32()))], ["id", "label", "cols", "stay"]
            )

    ident = rows.schema["_d_id"].dataType.simpleString()
    got = rows.mapInArrow(columns, f"id {ident}, label int, cols array<int>, stay array<int>").orderBy("id", "label", "cols").toArrow().combine_chunks()
    size = pc.fill_null(pc.list_value_length(got.column("cols")), 0).to_numpy()
    col = pc.list_flatten(got.column("cols")).to_numpy().astype(np.int64)
    staying = frozenset((r, c) for r, cols in enumerate(got.column("stay").to_pylist()) for c in cols or ())
    return fit(column, np.repeat(np.arange(got.num_rows), size), col, got.column("label").to_numpy(), staying=staying, **options)


def toxicity_scores(
    docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (default: all) and a score from 0 to 1; null and empty texts get the score of no words.

    Each row is scored on its own: nothing is shuffled, repeated rows and any other columns are fine.
    """
    keep = kept_columns(docs, keep, (score_col,))
    rows = docs.select(*quoted(keep), F.col(text_col).alias("_q_text"))
    model_ = docs.sparkSession.sparkContext.broadcast(model)
    schema = "".join(f"`{n}` {t}, " for n, t in rows.dtypes if n != "_q_text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model_.value.score
        for batch in batches:
            found = pa.array([score(x.as_py()) for x in batch.column(batch.num_columns - 1)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*keep, score_col])

    return rows.mapInArrow(scored, f"{schema}`{score_col}` double")
