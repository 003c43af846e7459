"""Lexical, readability and quality metrics of texts and word arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsieve.functions import text as T
from quillsieve.functions.text import _col

OVER_DELETION = 0.75


def _factors(words, threshold: float) -> float:
    """Words for each stretch over which the share of different words stays above the threshold."""
    seen: set[str] = set()
    n, factors = 0, 0.0
    for w in words:
        n += 1
        seen.add(w)
        if len(seen) <= threshold * n:
            factors += 1
            seen, n = set(), 0
    if n and len(seen) < n:
        factors += (1 - len(seen) / n) / (1 - threshold)
    return len(words) / factors if factors else float(len(words))


def _lowered(words: Column | str) -> Column:
    """The words in lower case as one string: a batch of strings reaches Python far faster than one of arrays."""
    return F.lower(F.array_join(_col(words), " "))


def mtld(words: Column | str, threshold: float = 0.72) -> Column:
    """Mean of both directions; null under ten words. A sequential fold, so it runs over Arrow batches."""

    @F.pandas_udf("double")
    def both(batch: pd.Series) -> pd.Series:
        split = (x.split(" ") if x else [] for x in batch)
        return pd.Series([(_factors(x, threshold) + _factors(x[::-1], threshold)) / 2 if len(x) >= 10 else None for x in split], dtype="float64")

    return both(_lowered(words))


def lexical_diversity(words: Column | str) -> Column:
    n = F.size(_col(words))
    return F.when(n > 0, F.size(F.array_distinct(F.transform(_col(words), F.lower))) / n).otherwise(0.0)


def _moving_diversity(words: list[str], window: int) -> float:
    """Kinds in all full windows: a word counts in those windows that start after its last occurrence before it."""
    n = len(words)
    if n < window:
        return len(set(words)) / n if n else 0.0
    last: dict[str, int] = {}
    before = np.empty(n, np.int64)
    for k, w in enumerate(words):
        before[k] = last.get(w, -1)
        last[w] = k
    k = np.arange(n)
    total = np.maximum(0, np.minimum(k, n - window) - np.maximum(before, np.maximum(k - window, -1))).sum()
    return int(total) / (window * (n - window + 1))


def mattr(words: Column | str, window: int = 50) -> Column:
    """Mean share of different words in all full windows; of the whole text if it is shorter.

    Over Arrow batches: as an expression every window would sort out its words anew.
    """

    @F.pandas_udf("double")
    def moving(batch: pd.Series) -> pd.Series:
        return pd.Series([_moving_diversity(x.split(" ") if x else [], window) for x in batch], dtype="float64")

    return moving(_lowered(words))


def sentence_length_score(average: Column) -> Column:
    return (
        F.when(average <= 0, 0.0)
        .when(average.between(8, 25), 1.0)
        .when(average < 8, average / 8)
        .otherwise(F.greatest(F.lit(0.0), 1 - (average - 25) / 40))
    )


def sentence_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(_col(text), "[.!?]+", -1), lambda s: s.rlike(r"(?U)\S")))


def immediate_repetitions(words: Column | str) -> Column:
    after = lambda low: F.slice(low, F.lit(2), F.greatest(F.size(low) - 1, F.lit(0)))
    return T.once(F.transform(_col(words), F.lower), lambda low: F.size(F.filter(F.zip_with(after(low), low, lambda a, b: a.isNotNull() & (a == b)), lambda x: x)))


def quality(average_length: Column, artifact_rate: Column, residue_rate: Column, noise: Column) -> Column:
    base = sentence_length_score(average_length) * 0.4 + (1 - artifact_rate) * 0.3 + (1 - residue_rate) * 0.3
    lost = (noise - OVER_DELETION) / (1 - OVER_DELETION)
    scored = F.when(noise > OVER_DELETION, base * F.greatest(F.lit(0.0), 1 - lost)).otherwise(base)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), scored))


def count_columns(original_words: Column, text: Column, word_array: Column, language: Column, prefix: str = "_") -> dict[str, Column]:
    """What the rates of a text are made of; to become columns before ``quality_columns`` reads each several times."""
    found = {
        "before": F.size(original_words),
        "n": F.size(word_array),
        "sentences": sentence_count(text),
        "commas": T.residual_commas(text),
        "residue": T.filler_count(word_array, language) + immediate_repetitions(word_array),
        "diversity": lexical_diversity(word_array),
        "mattr": mattr(word_array),
    }
    return {prefix + k: v for k, v in found.items()}


def quality_columns(prefix: str = "_") -> dict[str, Column]:
    """Unrounded metrics of a text from its ``count_columns``."""
    before, n, sentences, commas, residue = (F.col(prefix + k) for k in ("before", "n", "sentences", "commas", "residue"))
    noise = F.when(before > 0, F.greatest(F.lit(0.0), (before - n) / before)).otherwise(0.0)
    average = F.when(sentences > 0, n / sentences).otherwise(n.cast("double"))
    rate = lambda x: F.when(n > 0, F.least(F.lit(1.0), x / n)).otherwise(1.0)
    return {
        "original_word_count": before,
        "processed_word_count": n,
        "noise_reduction_rate": noise,
        "lexical_diversity": F.col(prefix + "diversity"),
        "mattr_score": F.col(prefix + "mattr"),
        "avg_sentence_length": average,
        "artifact_rate": rate(commas),
        "residual_comma_count": commas,
        "quality_score": quality(average, rate(commas), rate(residue), noise),
    }


def flesch(text: Column | str, language: Column | str) -> Column:
    """Reading ease, with the base for Portuguese where that is the language; 0 for no words."""
    base = F.when(_col(language) == "pt", 248.835).otherwise(206.835)
    syllables = lambda w: F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + T.syllables(x))
    counts = T.once(T.words(text), lambda w: F.struct(F.size(w).alias("n"), syllables(w).alias("syllables")))
    counts = F.struct(counts.alias("w"), F.size(T.sentence_words(text)).alias("sentences"))

    def ease(c: Column) -> Column:
        n, sentences = c["w"]["n"], c["sentences"]
        found = base - 1.015 * (n / sentences) - 84.6 * (c["w"]["syllables"] / n)
        return F.when((n > 0) & (sentences > 0), F.greatest(F.lit(0.0), F.least(F.lit(100.0), found))).otherwise(0.0)

    return T.once(counts, ease)


def run_on_rate(text: Column | str, longest: int = 40) -> Column:
    """Share of words in sentences of more than ``longest`` words; 1 for no words."""
    sizes = F.transform(T.sentence_words(text), F.size)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return T.once(sizes, lambda a: F.when(F.size(a) > 0, total(F.filter(a, lambda n: n > longest)) / total(a)).otherwise(1.0))
