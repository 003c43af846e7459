"""Token counts of a unigram segmentation, by forward scores along a trie of pre-tokens."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import discard, kept_columns, materialised, quoted

SPACE = "▁"


class UnigramCounter:
    """Counts the tokens of the best segmentation of each pre-token.

    Distinct pre-tokens of a batch are walked as a trie, in sorted order: the forward
    score of a prefix (its best total and the tokens of that) is computed once for all
    that share it, and the count at a pre-token's last node is stored. A character outside
    the vocabulary costs one token for each of its bytes.
    """

    def __init__(self, scores: dict[str, float], most: int = 1_000_000):
        self.scores = scores
        #: Scores of the pieces; None for what only ends one, so that a search backwards stops where no piece can end so.
        self.endings: dict[str, float | None] = {p[k:]: None for p in scores for k in range(1, len(p))} | scores
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.most = most
        self.stored: dict[str, int] = {}

    def _walk(self, words: list[str]) -> Iterator[tuple[str, list[float], list[int], list[int]]]:
        """For each of the sorted words, its text with the space and the lists of its prefixes: best score, tokens of that, begin of the last piece."""
        endings, unknown, nothing = self.endings, self.unknown, object()
        path = ""  # the prefix whose nodes the lists hold, from the root on
        total, tokens, back = [0.0], [0], [0]
        for word in words:
            text = SPACE + word
            same = 0
            for a, b in zip(path, text, strict=False):
                if a != b:
                    break
                same += 1
            del total[same + 1 :], tokens[same + 1 :], back[same + 1 :]
            for end in range(same + 1, len(text) + 1):
                char = text[end - 1]
                best = endings.get(char)
                n, at = 1, end - 1
                if best is None:
                    n = len(char.encode("utf-8", "surrogatepass"))
                    best = unknown * n
                best += total[end - 1]
                n += tokens[end - 1]
                for start in range(end - 2, -1, -1) if char in endings else ():
                    own = endings.get(text[start:end], nothing)
                    if own is nothing:
                        break
                    if own is not None:
                        own += total[start]
                        if own > best or own == best and tokens[start] + 1 < n:
                            best, n, at = own, tokens[start] + 1, start
                total.append(best)
                tokens.append(n)
                back.append(at)
            path = text
            yield text, total, tokens, back

    def add(self, words: set[str]) -> None:
        """Stores the counts of words that are new."""
        for text, _, tokens, _ in self._walk(sorted(words)):
            self.stored[text[1:]] = tokens[-1]

    def segments(self, words: list[str]) -> Iterator[list[str]]:
        """The pieces of each of the sorted words' best segmentation, from the last to the first."""
        for text, _, _, back in self._walk(words):
            pieces, end = [], len(text)
            while end:
                pieces.append(text[back[end] : end])
                end = back[end]
            yield pieces

    def count(self, texts: list[str | None], block_chars: int = 4_000_000) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text; pre-tokens stand between white space."""
        found: list[tuple[int, int]] = []
        block, size = [], 0
        for k, text in enumerate(texts, 1):
            block.append(text or "")
            size += len(text or "")
            if size >= block_chars or k == len(texts):
                found += self._count_block([t.split() for t in block])
                block, size = [], 0
        return found

    def _count_block(self, parts: list[list[str]]) -> list[tuple[int, int]]:
        stored = self.stored
        if len(stored) > self.most:
            stored.clear()
        self.add({w for own in parts for w in own if w not in stored})
        return [(len(own), sum(map(stored.__getitem__, own))) for own in parts]


@cache
def vocabulary(model_file: str) -> tuple[str, ...]:
    """The pieces of a public model in their order; its scores are merge ranks and no probabilities."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    return tuple(model.id_to_piece(i) for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))


def rank_scores(pieces: tuple[str, ...]) -> dict[str, float]:
    """Log probabilities in Zipf's proportion of the ranks, from which the fit starts."""
    whole = math.fsum(1 / (r + 2) for r in range(len(pieces)))
    return {p: -math.log((r + 2) * whole) for r, p in enumerate(pieces)}


def _pretokens(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """A row for each distinct pre-token of a part of the task's texts, with its count."""
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            held.update((text.as_py() or "").split())
            if len(held) >= most:
                yield out()
                held.clear()
    if held:
        yield out()


def fit_scores(docs: DataFrame, pieces: tuple[str, ...], text_col: str = "text", rounds: int = 1, least_parts: int = 8) -> tuple[dict[str, float], list[float]]:
    """Log probabilities of a unigram model with the given pieces, and the mean log likelihood of a pre-token's pieces before each round.

    Characters outside the vocabulary have no part in it: their score is no probability.

    Pre-tokens of the whole corpus are counted on Spark. A round segments each distinct one by the
    scores it has, counts the pieces with the pre-tokens' counts, and takes the smoothed shares as
    new scores (expectation maximisation over best segmentations). What comes to the driver and
    is broadcast is a number for each piece of the vocabulary. An empty corpus keeps the start.
    """
    words = docs.select(F.col(text_col)).mapInArrow(_pretokens, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    parts = max(least_parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    words = materialised(words.repartitionByRange(parts, "word").sortWithinPartitions("word"))  # neighbours in the trie meet in a task
    scores, likelihood = rank_scores(pieces), []
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(scores)

        def counted(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            counter = UnigramCounter(shared.value)
            found: Counter[str] = Counter()
            total, places = 0.0, 0
            for batch in batches:
                rows = sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                for own, (_, n) in zip(counter.segments([w for w, _ in rows]), rows, strict=True):
                    places += n
                    for p in own:
                        found[p] += n
                        total += n * shared.value.get(p, 0.0)
            known = [p for p in found if p in shared.value]
            yield pa.RecordBatch.from_arrays(
                [pa.array([*known, None], pa.string()), pa.array([found[p] for p in known] + [places], pa.int64()), pa.array([0.0] * len(known) + [total], pa.float64())], ["piece", "n", "score"]
            )

        sums = {r.piece: r for r in words.mapInArrow(counted, "piece string, n long, score double").groupBy("piece").agg(F.sum("n").alias("n"), F.sum("score").alias("score")).collect()}
        whole = sums.pop(None, None)
        if whole is None or not whole.n:
            break
        likelihood.append(whole.score / whole.n)
        all_ = sum(r.n for r in sums.values()) + len(pieces)
        scores = {p: math.log(((sums[p].n if p in sums else 0) + 1) / all_) for p in pieces}
    discard(words)
    return scores, likelihood


def token_counts(docs: DataFrame, scores: dict[str, float], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but the text) with ``n_pretokens`` and ``n_tokens`` by the scores of pieces, as ``fit_scores`` gives.

    Null, empty and blank texts have none. Rows are counted where they are read: nothing is
    shuffled, so repeated rows and hot sources cost no more than others.
    """
    made = ("n_pretokens", "n_tokens")
    keep = kept_columns(docs, keep, (*made, text_col) if keep is None else made)
    rows = docs.select(*quoted(keep), F.col(text_col).alias("_q_text"))
    schema = "".join(f"`{n}` {t}, " for n, t in rows.dtypes if n != "_q_text")

    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(shared.value, most=300_000)
        for batch in batches:
            found = counter.count(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())],
                [*keep, "n_pretokens", "n_tokens"],
            )

    return rows.mapInArrow(counted, f"{schema}n_pretokens long, n_tokens long")
