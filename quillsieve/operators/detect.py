"""Language detection by letter n-gram profiles that are counted on Spark, with a Bayesian posterior for every text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_OTHER = re.compile(r"[\W\d_]+")
_BLOCK = 1 << 16


def gram_hashes(text: str, longest: int = 3) -> Iterator[np.ndarray]:
    """Hashes of the letter n-grams of lengths 1 to ``longest`` of the lower-cased text, word ends included (but no space alone), in blocks of bounded size."""
    line = " " + _OTHER.sub(" ", text.lower()).strip() + " "
    if line.isspace():
        return
    for at in range(0, len(line), _BLOCK):
        some = np.frombuffer(line[at : at + _BLOCK + longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        own, packed = min(_BLOCK, len(line) - at), np.zeros(len(some), np.int64)
        for n in range(1, min(longest, len(some)) + 1):
            packed = (packed[: len(some) - n + 1] << 21) | some[n - 1 :]  # 21 bits hold a code point, so three letters are exact
            yield packed[:own] if n > 1 else packed[:own][packed[:own] != ord(" ")]


@dataclass
class Profiles:
    """Sorted n-grams, the logarithm of each one's share in each language, and the languages' logarithmic priors."""

    languages: list[str]
    grams: np.ndarray
    logs: np.ndarray
    priors: np.ndarray
    longest: int = 3

    def posterior(self, text: str) -> np.ndarray | None:
        """The chance of each language given the text's known n-grams; none where it has none."""
        total, met = self.priors.copy(), 0
        for grams in gram_hashes(text, self.longest):
            seen, n = np.unique(grams, return_counts=True)
            at = np.minimum(np.searchsorted(self.grams, seen), len(self.grams) - 1)
            known = self.grams[at] == seen
            met += int(known.sum())
            total += n[known] @ self.logs[at[known]]
        if not met:
            return None
        chance = np.exp(total - total.max())
        return chance / chance.sum()


def fit_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, most: int = 3000, smooth: float = 0.5) -> Profiles:
    """Counts the n-grams of every row of a known language and keeps the ``most`` frequent of each language.

    Tasks count their batches first; languages times ``most`` n-grams reach the driver. Shares
    are smoothed by ``smooth``; priors are the languages' shares of texts. Rows of null text or language are left out.
    """
    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some, held = batch.slice(k, 256), {}
                for name, value in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    held.setdefault(name, []).extend(gram_hashes(value, longest))
                for name, parts in held.items():
                    grams, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    counts = known.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")  # distinct n-grams of one language: an alphabet bounds them, not the corpus
    top = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    got = top.select("lang", "gram", "n").toArrow()
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    grams = np.unique(got.column("gram").to_numpy())
    table = np.zeros((len(grams), len(languages)))
    place = np.searchsorted(grams, got.column("gram").to_numpy())
    table[place, [languages.index(x) for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    table += smooth
    total = sum(sizes.values())
    return Profiles(languages, grams, np.log(table / table.sum(axis=0)) if len(grams) else table, np.log([sizes[x] / total for x in languages]) if total else np.zeros(0), longest)


def detected_language(text: Column | str, fallback: Column | str, profiles: Profiles, least: int = 5) -> Column:
    """struct(language, chance): the likeliest language; the fallback, with no chance, for fewer than ``least`` tokens or no known n-gram.

    Of equally likely languages the first in order is taken. One kernel a text, in Arrow batches; a null text takes the fallback.
    """

    @F.pandas_udf("struct<language:string,chance:double>")
    def detected(texts: pd.Series, fallbacks: pd.Series) -> pd.DataFrame:
        rows = []
        for value, other in zip(texts, fallbacks, strict=True):
            chances = profiles.posterior(value) if profiles.languages and len(profiles.grams) and isinstance(value, str) and len(value.split(None, least)) >= least else None
            best = None if chances is None else int(np.argmax(chances))
            rows.append((other, None) if best is None else (profiles.languages[best], float(chances[best])))
        return pd.DataFrame(rows, columns=["language", "chance"])

    return detected(text, fallback)
