"""Raw against processed texts, and the reliability of judges."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from quillsieve.functions import lexicons as L
from quillsieve.functions import metrics as M
from quillsieve.functions import text as T
from quillsieve.sources.config import checkpointed

# Metric, family, whether higher is better.
METRICS = (
    ("flesch", "independent", True),
    ("avgSentenceLength", "independent", False),
    ("runOnRate", "independent", False),
    ("qualityScore", "rule-based", True),
    ("fillerDensity", "rule-based", False),
    ("repetitionDensity", "rule-based", False),
    ("orphanCommaRate", "rule-based", False),
    ("mtld", "preservation", True),
    ("mattr", "preservation", True),
)


def text_metrics(docs: DataFrame, text: str, language: str, prefix: str) -> DataFrame:
    """``docs`` with the nine metrics of a text as ``prefix_name``; MTLD is null where it is undefined."""
    w, p = f"_{prefix}_words", f"_{prefix}_"
    df = docs.withColumn(w, T.words(text))
    counts = M.count_columns(F.col(w), F.col(text), F.col(w), F.col(language), p)
    own = {f"{p}fillers": T.filler_count(w, language), f"{p}repeats": M.immediate_repetitions(F.col(w)), f"{p}mtld": M.mtld(w)}
    df = df.withColumns(counts | own)
    q = M.quality_columns(p)
    n = F.greatest(F.lit(1), F.size(w))
    found = {
        "flesch": M.flesch(text, language),
        "avgSentenceLength": F.round(q["avg_sentence_length"], 2),
        "runOnRate": M.run_on_rate(text),
        "qualityScore": F.round(q["quality_score"], 4),
        "fillerDensity": F.col(f"{p}fillers") / n,
        "repetitionDensity": F.col(f"{p}repeats") / n,
        "orphanCommaRate": q["residual_comma_count"] / n,
        "mattr": F.round(q["mattr_score"], 4),
        "mtld": F.round(f"{p}mtld", 4),
    }
    return df.withColumns({f"{prefix}_{k}": v for k, v in found.items()}).drop(w, *counts, *own)


_FOLDS = str.maketrans(*L.accent_folds())
_FILLER_KEYS = {k: frozenset(w.translate(_FOLDS) for w in v) for k, v in L.FILLERS.items()}


@F.pandas_udf(DoubleType())
def _kept_share(raw: pd.Series, processed: pd.Series, langs: pd.Series) -> pd.Series:
    def one(a: str | None, b: str | None, lang: str | None) -> float:
        listed = _FILLER_KEYS.get(lang, _FILLER_KEYS["en"])
        own, new = Counter(w for w in a.split(" ") if w not in listed) if a else Counter(), Counter(b.split(" ") if b else ())
        total = own.total()
        return (own & new).total() / total if total else 1.0

    return pd.Series([one(*x) for x in zip(raw, processed, langs, strict=True)], dtype="float64")


@F.pandas_udf(LongType())
def shared_words(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many words two texts of single spaces share, counted with repeats; null counts as empty."""
    split = lambda x: Counter(x.split(" ") if x else ())
    return pd.Series([(split(x) & split(y)).total() for x, y in zip(a, b, strict=True)], dtype="int64")


def retained(raw: Column | str, processed: Column | str, language: Column | str) -> Column:
    """The share of the raw words, hesitations aside, that the processed text has as often; 1 for none. Counted where the row is: no word is shuffled."""
    return _kept_share(T.joined_keys(raw), T.joined_keys(processed), language)


def content_retention(docs: DataFrame, id_col: str, raw: str, processed: str, language: str) -> DataFrame:
    """(id, retention) by ``retained``."""
    return docs.select(id_col, retained(raw, processed, language).alias("retention"))


def paired_texts(raw: DataFrame, processed: DataFrame, id_col: str) -> DataFrame:
    """(id, raw, processed) of the documents that both tables have; a null processed text counts as the raw one."""
    both = raw.select(id_col, "raw").join(processed.select(id_col, F.col("processed").alias("_p")), id_col)
    return both.select(id_col, "raw", F.coalesce("_p", "raw").alias("processed"))


def evaluate_documents(docs: DataFrame, id_col: str, raw: str, processed: str, language: str) -> DataFrame:
    """One row a document: its group (auto where the raw text lacks punctuation), words, retention and both metric sets."""
    df = text_metrics(text_metrics(docs, raw, language, "raw"), processed, language, "processed")
    df = df.withColumns({"group": F.when(T.needs_punctuation(raw), "auto").otherwise("punctuated"), "words": F.size(T.words(raw))})
    return df.withColumn("retention", retained(raw, processed, language))


RESAMPLES = 2000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Of a count drawn from the Poisson distribution of mean 1: the chances of at most 0, 1, 2 ... as shares of 2**32.
_AT_MOST = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)]) * 2.0**32


def poisson_weights(row_hashes: np.ndarray, resamples: int = RESAMPLES) -> np.ndarray:
    """How often each row stands in each resample: Poisson counts from a hash of row and resample, the same wherever the row is."""
    draw = np.arange(1, resamples + 1, dtype=np.uint64) * _GOLDEN
    h = row_hashes.view(np.uint64)[:, None] + draw[None, :]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    high = (h >> np.uint64(32)).astype(np.uint32)
    out = np.zeros(high.shape, np.float32)
    for chance in _AT_MOST[:-1]:
        out += high > np.uint32(chance)
    return out


def average_ranks(rows: DataFrame, keys: list[str], value: str, times: str | None = None) -> DataFrame:
    """(keys, value, n, rank): each distinct value of a key with its count (of rows, or the sum of ``times``) and average rank, from 1.

    Values are counted, dealt out by range and summed within the ranges; only the ranges'
    totals of a key are added up in one place, so no key's rows meet in one task.
    """
    counted = rows.groupBy(*keys, value).agg((F.sum(times) if times else F.count("*")).alias("n"))
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = checkpointed(counted.repartitionByRange(parts, *keys, value).withColumn("_range", F.spark_partition_id()))
    totals = counted.groupBy(*keys, "_range").agg(F.sum("n").alias("t"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col("_range").alias("_t_range"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys]
    joined = counted.join(totals, [*same, F.col("_range") == F.col("_t_range")]).select(*counted.columns, "_before")  # totals: a row for each range and key
    local = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum("n").over(local), F.lit(0))
    return joined.withColumn("rank", before + (F.col("n") + 1) / 2).drop("_before", "_range")


@F.pandas_udf(DoubleType())
def wilcoxon_p(n: pd.Series, positive: pd.Series, ties: pd.Series) -> pd.Series:
    """Two-sided p-value of a signed-rank sum: exact for up to 50 differences without ties, else by the normal curve."""

    def exact(n: int, w: float) -> float:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[: len(ways) - k]
        ways /= 2.0**n
        low = min(w, n * (n + 1) / 2 - w)
        return min(1.0, 2 * float(ways[: int(low) + 1].sum()))

    def one(n: int, w: float, ties: float) -> float:
        if n == 0:
            return 1.0
        if n <= 50 and not ties:
            return exact(n, w)
        spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
        return math.erfc(abs((w - n * (n + 1) / 4) / spread) / math.sqrt(2)) if spread else 1.0

    return pd.Series([one(int(a), float(b), float(c)) for a, b, c in zip(n, positive, ties, strict=True)])


def paired_rows(evaluated: DataFrame, id_col: str) -> DataFrame:
    """(id, stratum, metric, raw, processed, delta, signed) for all documents and each group; undefined pairs left out."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(h).alias("higher"), F.col(f"raw_{n}").cast("double").alias("raw"), F.col(f"processed_{n}").cast("double").alias("processed")) for n, _, h in METRICS])
    rows = evaluated.select(id_col, F.explode(F.array(F.lit("all"), F.col("group"))).alias("stratum"), pairs.alias("p")).select(id_col, "stratum", F.explode("p").alias("p")).select(id_col, "stratum", "p.*")
    rows = rows.where("raw is not null and processed is not null and not isnan(raw) and not isnan(processed)").withColumn("delta", F.col("processed") - F.col("raw"))
    return rows.withColumn("signed", F.when(F.col("higher"), F.col("delta")).otherwise(-F.col("delta")))


def _signed_ranks(rows: DataFrame) -> DataFrame:
    """A row a stratum and metric from ``paired_rows``: differences that are not 0, their rank sums and the ties among them."""
    sized = rows.where("signed <> 0").select("stratum", "metric", F.abs("signed").alias("size"), (F.col("signed") > 0).alias("up"))
    ranks = average_ranks(sized, ["stratum", "metric"], "size").withColumnRenamed("n", "of_size")
    ups = sized.groupBy("stratum", "metric", "size").agg(F.count_if("up").alias("ups"))
    both = ranks.join(ups, ["stratum", "metric", "size"])
    n, ups = F.col("of_size"), F.col("ups")
    return both.groupBy("stratum", "metric").agg(
        F.sum(n).alias("changed"), F.sum(ups * F.col("rank")).alias("rank_up"), F.sum(n * F.col("rank")).alias("rank_sum"),
        F.sum((n * n * n - n).cast("double")).alias("ties"),
    )


def paired_stats(evaluated: DataFrame, id_col: str) -> DataFrame:
    """One row a stratum and metric: n, means, shares and the rank-biserial effect (average ranks)."""
    rows = paired_rows(evaluated, id_col)
    effect = _signed_ranks(rows).select("stratum", "metric", ((2 * F.col("rank_up") - F.col("rank_sum")) / F.col("rank_sum")).alias("effect"))
    plain = rows.groupBy("stratum", "metric").agg(
        F.count("*").alias("n"), F.avg("raw").alias("raw"), F.avg("processed").alias("processed"), F.avg("delta").alias("delta"),
        F.avg((F.col("signed") > 0).cast("double")).alias("improved"), F.avg((F.col("signed") < 0).cast("double")).alias("worsened"),
    )
    plain = plain.withColumn("relative", F.col("delta") / F.nullif(F.col("raw"), F.lit(0.0)))
    return plain.join(effect, ["stratum", "metric"], "left").withColumn("effect", F.coalesce("effect", F.lit(0.0)))


def _resampled(batches: Iterator[pd.DataFrame], metrics: list[str], resamples: int) -> Iterator[pd.DataFrame]:
    """For each stratum and metric of a task, the weighted sums and the weights of every resample."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for k in range(0, len(batch), 1000):
            some = batch.iloc[k : k + 1000]
            weights = poisson_weights(some["_h"].to_numpy(np.int64), resamples)
            delta = some[metrics].to_numpy(np.float64)
            known = ~np.isnan(delta)
            for stratum in {"all", *some["group"].dropna()}:
                own = np.ones(len(some), bool) if stratum == "all" else (some["group"] == stratum).to_numpy()
                w = weights[own].astype(np.float64)
                held = total.setdefault(stratum, np.zeros((2, len(metrics), resamples)))
                held[0] += np.where(known, delta, 0)[own].T @ w
                held[1] += known[own].T.astype(np.float64) @ w
    for stratum, held in total.items():
        for m, name in enumerate(metrics):
            yield pd.DataFrame({"stratum": stratum, "metric": name, "r": np.arange(resamples), "s": held[0, m], "w": held[1, m]})


def paired_intervals(evaluated: DataFrame, id_col: str, resamples: int = RESAMPLES) -> DataFrame:
    """Bootstrap 95 % interval of the mean change and Wilcoxon's p-value.

    Rows are drawn by Poisson counts (the bootstrap of a sample too large to be held in one
    place): tasks sum up their rows for each resample, and the sums of all tasks are added.
    """
    names = [n for n, _, _ in METRICS]
    delta = [(F.col(f"processed_{n}").cast("double") - F.col(f"raw_{n}").cast("double")).alias(n) for n in names]
    wide = evaluated.select(F.xxhash64(F.col(id_col).cast("string")).alias("_h"), F.col("group").cast("string").alias("group"), *delta)
    sums = wide.mapInPandas(lambda b: _resampled(b, names, resamples), "stratum string, metric string, r int, s double, w double")
    means = sums.groupBy("stratum", "metric", "r").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("mean"))
    ends = means.groupBy("stratum", "metric").agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    ends = ends.where("p is not null").select("stratum", "metric", F.col("p")[0].alias("ci_low"), F.col("p")[1].alias("ci_high"))
    tested = _signed_ranks(paired_rows(evaluated, id_col))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    found = ends.join(tested, ["stratum", "metric"], "left")
    return found.select("stratum", "metric", "ci_low", "ci_high", wilcoxon_p(zero("changed"), zero("rank_up"), zero("ties")).alias("p"))


def _even_odds(k: int, n: int) -> float:
    """The chance of exactly ``k`` heads in ``n`` throws, by deviations from Stirling's formula, which lose no digits for large ``n``."""
    if k in (0, n):
        return math.exp(-n * math.log(2))
    rest = lambda x: math.lgamma(x + 1) - (x + 0.5) * math.log(x) + x - 0.5 * math.log(2 * math.pi) if x < 16 else (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x * x)) / (x * x)) / (x * x)) / x
    t = (2 * k - n) / n  # the throws part as (1 + t) / 2 and (1 - t) / 2
    spread = n / 2 * ((1 + t) * math.log1p(t) + (1 - t) * math.log1p(-t))
    return math.exp(rest(n) - rest(k) - rest(n - k) - spread) * math.sqrt(n / (2 * math.pi * k * (n - k)))


def _tail(k: int, n: int) -> float:
    """The chance of at most ``k`` < n / 2 heads: the incomplete beta function at 1/2 as a continued fraction, whose steps grow by the root of ``n`` at most."""
    a, b, tiny = n - k, k + 1, 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * 0.5 / (a + 1))
    h, m = d, 0
    while True:
        m += 1
        even = m * (b - m) * 0.5 / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1.0 / ((1.0 + even * d) or tiny), (1.0 + even / c) or tiny
        h *= d * c
        odd = -(a + m) * (a + b + m) * 0.5 / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1.0 / ((1.0 + odd * d) or tiny), (1.0 + odd / c) or tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15 or m > 1_000_000:
            break
    return _even_odds(k, n) * h / 2


def even_odds_p(wins: int, n: int) -> float:
    """Two-sided exact binomial p-value at even odds; 1 without verdicts."""
    k = min(wins, n - wins)
    return 1.0 if not n or 2 * k == n else min(1.0, 2 * _tail(k, n))


@F.pandas_udf(DoubleType())
def sign_test(wins: pd.Series, losses: pd.Series) -> pd.Series:
    """``even_odds_p`` of wins among wins and losses."""
    return pd.Series([even_odds_p(int(w), int(w + x)) for w, x in zip(wins, losses, strict=True)])


def judge_table(verdicts: DataFrame) -> DataFrame:
    """One row for all verdicts and each group: wins, losses, ties, consistency and the sign test."""
    rows = verdicts.withColumn("grp", F.explode(F.array(F.lit("all"), F.col("group"))))
    n = lambda o: F.count_if(F.col("outcome") == o)
    table = rows.groupBy("grp").agg(
        F.count("*").alias("n"), n("processed").alias("wins"), n("raw").alias("losses"),
        (F.count("*") - n("processed") - n("raw")).alias("ties"), F.avg(F.col("position_consistent").cast("double")).alias("consistency"),
    )
    return table.withColumn("p", sign_test("wins", "losses"))


def kappa(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row of label pairs: n, agreement and Cohen's kappa; without pairs all are 0."""
    n = pairs.agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"))
    counts = pairs.groupBy(F.col(a).alias("l")).agg(F.count("*").alias("na")).join(pairs.groupBy(F.col(b).alias("l")).agg(F.count("*").alias("nb")), "l")
    expected = counts.agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("s"))
    e = F.coalesce("s", F.lit(0.0)) / F.nullif(F.col("n") * F.col("n"), F.lit(0))
    value = F.when(F.col("n") == 0, 0.0).when(e >= 1, F.when(F.col("agreement") == 1, 1.0).otherwise(0.0)).otherwise((F.col("agreement") - e) / F.nullif(1 - e, F.lit(0.0)))
    return n.join(F.broadcast(expected)).select("n", F.coalesce("agreement", F.lit(0.0)).alias("agreement"), value.alias("kappa"))  # one row each


def agreement_with_humans(judged: DataFrame, human: DataFrame, order: str) -> DataFrame:
    """Kappa of (id, outcome) against the last human row of each id by ``order``."""
    last = human.groupBy("id").agg(F.max_by("outcome", order).alias("b"))
    return kappa(judged.select("id", F.col("outcome").alias("a")).join(last, "id"))


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation for each key; 0 for fewer than two rows or a constant side. Equal pairs are counted before anything is joined."""
    pairs = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_n"))
    pairs = checkpointed(pairs)
    joined = pairs
    for side in ("_x", "_y"):
        ranks = average_ranks(pairs, keys, side, "_n")
        renamed = ranks.select(*[F.col(k).alias(f"{side}{k}") for k in keys], F.col(side).alias(f"{side}v"), F.col("rank").alias(f"{side}r"))
        joined = joined.join(renamed, [*[F.col(k).eqNullSafe(F.col(f"{side}{k}")) for k in keys], F.col(side) == F.col(f"{side}v")])
    n, a, b = F.col("_n"), F.col("_xr"), F.col("_yr")
    moments = joined.groupBy(*keys).agg(
        F.sum(n).alias("n"), F.sum(n * a).alias("a"), F.sum(n * b).alias("b"), F.sum(n * a * a).alias("aa"), F.sum(n * b * b).alias("bb"), F.sum(n * a * b).alias("ab"),
        (F.sum(n * F.abs(F.col("_x") - F.col("_y"))) / F.sum(n)).alias("mean_abs_diff"),
    )
    cov, va, vb = (F.col(p) - F.col(q) * F.col(r) / F.col("n") for p, q, r in (("ab", "a", "b"), ("aa", "a", "a"), ("bb", "b", "b")))
    return moments.select(*keys, F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).otherwise(0.0).alias("rho"), "mean_abs_diff")


def variant_stability(scores: DataFrame) -> DataFrame:
    """One row from (variant, doc, score): mean rank correlation and largest mean difference over all pairs of variants.

    Pairs meet on the document, so rows grow with the square of the variants (a handful), not of the documents.
    """
    a = scores.select(F.col("variant").alias("va"), "doc", F.col("score").alias("x"))
    b = scores.select(F.col("variant").alias("vb"), "doc", F.col("score").alias("y"))
    pairs = spearman(a.join(b, "doc").where("va < vb"), ["va", "vb"], "x", "y")
    return pairs.agg(F.coalesce(F.avg("rho"), F.lit(1.0)).alias("mean_spearman"), F.coalesce(F.max("mean_abs_diff"), F.lit(0.0)).alias("max_mean_abs_diff"))


def retention_summary(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(F.avg("retention").alias("mean_retention"), F.min("retention").alias("least_retention"), F.count("*").alias("n"))


def number(x: Column, digits: int) -> Column:
    return F.when(x.isNull() | F.isnan(x), "—").otherwise(F.format_string(f"%.{digits}f", x))


def p_value(x: Column) -> Column:
    return F.when(x < 0.001, "<0.001").otherwise(F.format_string("%.3f", x))


def metrics_report(stats: DataFrame, intervals: DataFrame) -> DataFrame:
    """A Markdown table row for each stratum and metric."""
    info = F.create_map(*[x for n, f, h in METRICS for x in (F.lit(n), F.concat(F.lit("↑" if h else "↓"), F.lit(" | "), F.lit(f)))])
    percent = lambda c, d: F.concat(number(F.col(c) * 100, d), F.lit("%"))
    cells = [
        F.concat("metric", F.lit(" "), F.element_at(info, F.col("metric"))), F.col("n").cast("string"), number(F.col("raw"), 3), number(F.col("processed"), 3),
        F.concat(number(F.col("delta"), 3), F.lit(" ["), number(F.col("ci_low"), 3), F.lit(", "), number(F.col("ci_high"), 3), F.lit("]")),
        percent("relative", 1), percent("improved", 0), percent("worsened", 0), p_value(F.col("p")), number(F.col("effect"), 2),
    ]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return stats.join(intervals, ["stratum", "metric"]).select("stratum", "metric", line.alias("line"))


def reliability_report(agreement: DataFrame, stability: DataFrame, label: str = "judge") -> DataFrame:
    """Markdown lines on a judge: agreement with humans, then stability over prompt variants, one row each."""
    told = agreement.select(
        F.lit(1).alias("at"),
        F.format_string("| %s vs human | n=%d | agreement %s%% | κ %s |", F.lit(label), "n", number(F.col("agreement") * 100, 1), number(F.col("kappa"), 3)).alias("line"),
    )
    stable = stability.select(
        F.lit(2).alias("at"),
        F.format_string("| %s variants | mean ρ %s | largest mean difference %s |", F.lit(label), number(F.col("mean_spearman"), 3), number(F.col("max_mean_abs_diff"), 3)).alias("line"),
    )
    return told.unionByName(stable)


def judge_report(table: DataFrame) -> DataFrame:
    """A Markdown table row for each group of ``judge_table``."""
    cells = [F.col(c).cast("string") for c in ("grp", "n", "wins", "losses", "ties")]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells, F.concat(number(F.col("consistency") * 100, 0), F.lit("%")), p_value(F.col("p"))), F.lit(" |"))
    return table.select("grp", line.alias("line"))
