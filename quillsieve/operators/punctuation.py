"""Punctuation restoration that never changes a word."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import batched, tee

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.functions import text as T
from quillsieve.operators.alignment import matching_words
from quillsieve.operators.calls import RateLimit, in_flight

#: Takes an excerpt and returns a proposal for it; raises where it has none.
Completer = Callable[[str], str]

# Marks that a word may end in, and what may close after them.
MARKS = ".,!?;:"
CLOSERS = "\"'”’)]"
#: Rows whose texts a task holds as strings at once.
_ROWS = 64
_LETTERS = re.compile(r"[^\W\d_]+")
_NO_LETTERS = re.compile(r"[^a-z]+")
#: Tokens of up to this length are remembered.
_CACHED = 32


def _letters(token: str) -> str:
    """The letters of a token in lower case without accents: what two tokens must share to be one word."""
    if token.isascii():
        low = token.lower()
        return low if low.isalpha() else _NO_LETTERS.sub("", low)
    return _folded(token) if len(token) <= _CACHED else _folded.__wrapped__(token)


@lru_cache(1 << 14)
def _folded(token: str) -> str:
    plain = unicodedata.normalize("NFD", token.lower())
    return "".join(_LETTERS.findall("".join(c for c in plain if unicodedata.category(c) != "Mn")))


def _body_and_mark(token: str) -> tuple[str, str]:
    if token[-1].isalpha():
        return token, ""
    shown = token.rstrip(CLOSERS)
    body = shown.rstrip(MARKS)
    mark = shown[len(body) :]
    return (body, mark) if mark and body else (token, mark)


def project(source: str, proposal: str) -> str:
    """The words of ``source`` with the marks and capitals that their counterparts in ``proposal`` have.

    A lower-case word takes its counterpart's capitals if the letters agree, and its mark in
    place of its own. Where words were put in, the mark after the last of them goes to
    the source's word before that place, unless it has one.
    """
    own, new = source.split(), proposal.split()
    if not own:
        return source
    pairs = matching_words([_letters(t) for t in own], [_letters(t) for t in new])
    shown, marks = list(own), [""] * len(own)
    alone = set() if len(pairs) == len(own) else set(range(len(own))).difference(i for i, _ in pairs)
    for i in alone:  # without a counterpart: as it was
        marks[i] = _body_and_mark(own[i])[1]
    for i, j in pairs:
        token, other = own[i], new[j]
        if token == other and token[-1].isalpha():
            continue
        body, _ = _body_and_mark(token)
        shape, marks[i] = _body_and_mark(other)
        if body.islower() and shape.lower() == body:
            body = shape
        shown[i] = body + marks[i]
    before = -1
    for i, j in [*pairs, (len(own), len(new))]:
        if j - before > 1 and i and not marks[i - 1]:
            shown[i - 1] += _body_and_mark(new[j - 1])[1]
        before = j
    return " ".join(shown)


def project_punctuation(source: Column | str, proposal: Column | str) -> Column:
    """``project`` over Arrow batches: an alignment has no built-in counterpart."""

    @F.pandas_udf("string")
    def aligned(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([project(x, y) if x is not None and y is not None else x for x, y in zip(a, b, strict=True)])

    return aligned(source, proposal)


def word_chunks(text: Column | str, size: int = 250) -> Column:
    """The text's tokens, ``size`` to a chunk."""
    tokens = F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != "")
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.array_join(F.slice(tokens, k, size), " "))


def few_at_a_time(batches: Iterator[pa.Array]) -> Iterator[list[str]]:
    """The lists of chunks of Arrow batches, none for null; a few rows at a time become strings, however large a batch is."""
    for batch in batches:
        for k in range(0, len(batch), _ROWS):
            for chunks in batch.slice(k, _ROWS).to_pylist():
                yield chunks or []


def restore_punctuation(
    docs: DataFrame, completer: Completer, text: str, attempts: int = 2, chunk_words: int = 250, window: int = 6, rate: RateLimit | None = None
) -> DataFrame:
    """``docs`` with marks in texts that lack them and ``punctuation_restored``: whether any chunk of the row succeeded.

    Chunks are proposed and aligned where their row is, ``window`` calls at a time in a task
    and over the ends of rows; ``rate`` bounds the calls of all tasks. A chunk that
    fails ``attempts`` times stays as it was.
    """
    limit = rate.shared(docs) if rate else None

    def proposed(chunk: str) -> str | None:
        return project(chunk, completer(chunk))

    @F.arrow_udf("struct<text:string,good:int>")
    def completed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        asked, kept = tee(few_at_a_time(batches))  # the first is ahead by the calls in flight
        answers = in_flight((c for chunks in asked for c in chunks), proposed, window, attempts, limit)
        for part in batched(kept, _ROWS):
            done = [[next(answers) for _ in chunks] for chunks in part]
            texts = [" ".join(c if n is None else n for c, n in zip(chunks, new, strict=True)) for chunks, new in zip(part, done, strict=True)]
            good = [sum(n is not None for n in new) for new in done]
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(good, pa.int32())], names=["text", "good"])

    lacking = T.needs_punctuation(text)
    df = docs.withColumn("_lacking", lacking).withColumn("_done", completed(F.when(F.col("_lacking"), word_chunks(text, chunk_words))))
    restored = F.col("_lacking") & (F.col("_done.good") > 0)
    return df.withColumns({text: F.when(F.col("_lacking"), F.col("_done.text")).otherwise(F.col(text)), "punctuation_restored": restored}).drop("_lacking", "_done")


def rule_completer(excerpt: str, every: int = 12) -> str:
    """A deterministic stand-in for a language model: a full stop after every twelfth word."""
    tokens = excerpt.split()
    out = []
    for k, token in enumerate(tokens):
        start = k % every == 0
        out.append((token.capitalize() if start else token) + ("." if k % every == every - 1 or k + 1 == len(tokens) else ""))
    return " ".join(out)
