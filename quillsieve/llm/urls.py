"""URL verdicts: the longest matching host and path rule, else gradient-boosted trees on lexical features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import checkpointed

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "n_chars", "host_chars", "path_chars", "host_labels", "path_depth", "digit_ratio", "path_digit_ratio", "symbol_ratio",
    "entropy", "host_entropy", "n_params", "n_hyphens", "longest_label", "has_fragment", "is_https",
    "suffix_pages", "suffix_blocked", "head_pages", "head_blocked", "first_path_pages", "first_path_blocked",
)
_STATISTICS = {"suffix": "suffix", "head": "head", "first_path": "first_path"}


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is a host and a path prefix; it fits the host and all its subdomains."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path; both empty for null or where no :// stands."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(rules: list[UrlRule], host: F.Column, path: F.Column) -> F.Column:
    """The longest pattern that fits, else null; of equal lengths the first in the list."""
    found = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.pattern)):  # what is wrapped last is tried first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(rule.pattern)).otherwise(found)
    return found


def _entropy(text: str) -> F.Column:
    """Bits a character, from the counts of its characters."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda c: (F.length(text) - F.length(F.replace(F.col(text), c, F.lit("")))) / n
    return F.aggregate(
        F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")),
        F.lit(0.0),
        lambda total, c: total - share(c) * F.log2(share(c)),
    )


def lexical(pages: DataFrame) -> DataFrame:
    """``pages`` (id, url, host, path, ...) with features of the url's text alone and the keys of its statistics."""
    count = lambda text, pattern: F.regexp_count(F.col(text), F.lit(pattern)).cast("double")
    ratio = lambda text, pattern: count(text, pattern) / F.greatest(F.length(text), F.lit(1))
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    return pages.withColumns(
        {
            "n_chars": F.length("url").cast("double"),
            "host_chars": F.length("host").cast("double"),
            "path_chars": F.length("path").cast("double"),
            "host_labels": count("host", r"[^.]+"),
            "path_depth": count("path", r"/[^/]+"),
            "digit_ratio": ratio("url", "[0-9]"),
            "path_digit_ratio": ratio("path", "[0-9]"),
            "symbol_ratio": ratio("url", "[^A-Za-z0-9./:]"),
            "entropy": _entropy("url"),
            "host_entropy": _entropy("host"),
            "n_params": F.when(query != "", F.size(F.split(query, "&"))).otherwise(0).cast("double"),
            "n_hyphens": count("url", "-"),
            "longest_label": F.coalesce(F.array_max(F.transform(F.split("host", r"\."), F.length)), F.lit(0)).cast("double"),
            "has_fragment": F.col("url").contains("#").cast("double"),
            "is_https": F.col("url").startswith("https:").cast("double"),
            "suffix": F.substring_index("host", ".", -1),
            "head": F.substring_index("host", ".", -2),
            "first_path": F.regexp_extract("path", r"^/([^/0-9]*)", 1),
        }
    )


FOLDS = 5


def _with_statistics(rows: DataFrame) -> DataFrame:
    """``rows`` with the statistics of their suffix, name and first path part, from one row for each key.

    The blocked share of a key leaves out the labels of the url's own fold, so that no label
    is a feature of its own url. Keys are pre-aggregated, and each table of keys is kept
    before its join, so that a key of very many pages is split there.
    """
    out = rows
    for name, key in _STATISTICS.items():
        sums = [F.coalesce(F.sum(F.when(F.col("fold") == k, F.col("label"))), F.lit(0.0)).alias(f"s{k}") for k in range(FOLDS)]
        counts = [F.count(F.when(F.col("fold") == k, F.col("label"))).alias(f"c{k}") for k in range(FOLDS)]
        known = checkpointed(rows.groupBy(F.col(key).alias("_key")).agg(F.log1p(F.count("*")).alias(f"{name}_pages"), *sums, *counts))
        every, seen = sum(F.col(f"s{k}") for k in range(FOLDS)), sum(F.col(f"c{k}") for k in range(FOLDS))
        own = lambda c: sum(F.when((F.col("fold") == k) & F.col("label").isNotNull(), F.col(f"{c}{k}")).otherwise(0) for k in range(FOLDS))
        share = (every - own("s") + 1) / (seen - own("c") + 2)
        out = out.join(known, F.col(key) == F.col("_key")).withColumn(f"{name}_blocked", share)
        out = out.drop("_key", *[f"{c}{k}" for c in "sc" for k in range(FOLDS)])
    return out


def url_features(pages: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, url, host, path, rule, label (1 for a blocking rule, null without one), fold and ``FEATURES`` of every page."""
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    blocked = F.coalesce(*(F.when(F.col("rule") == r.pattern, F.lit(float(r.verdict == "block"))) for r in rules))
    rows = rows.withColumn("rule", matched_rule(rules, F.col("host"), F.col("path"))).withColumn("label", blocked)
    rows = lexical(rows).withColumn("fold", F.pmod(F.xxhash64("url", F.lit(FOLDS)), F.lit(FOLDS)).cast("int"))
    rows = checkpointed(rows)
    return checkpointed(_with_statistics(rows).select("id", "url", "host", "path", "rule", "label", "fold", *FEATURES))


def held_out_auc(rows: DataFrame, **options) -> float:
    """Area under the ROC curve on fold 0 of ``url_features`` for trees that learn from the other folds."""
    scored = _trained(rows.where("fold <> 0"), **options).transform(_assembler().transform(rows.where("fold = 0 and label is not null")))
    return BinaryClassificationEvaluator(labelCol="label").evaluate(scored)


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features")


def _trained(rows: DataFrame, sample: int = 20_000, trees: int = 20, depth: int = 4, seed: int = 7):
    labelled = rows.where("label is not null")
    share = min(1.0, sample / max(labelled.count(), 1))
    drawn = labelled.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, cacheNodeIds=False, maxBins=32).fit(_assembler().transform(drawn).select("features", "label"))


def url_verdicts(pages: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """One row per page: id, host, path, ``rule`` (or null), ``verdict`` and ``block_score`` of the trees.

    The urls that a rule judges are the labelled ones; the trees learn from about
    ``sample`` of them, drawn by a hash of the url, and judge the others. Statistics of the
    suffix, the registered name and the first path part cover every page: how many pages
    have it, and the smoothed share of blocked ones among those that a rule judges, without
    those of the url's own fold of five. A null or malformed url has an empty host and path
    and all-zero text features. Where no rule fits any page, or all that fit agree, the trees have
    nothing to tell apart: pages without a rule are then allowed. Repeated rows keep a row each.
    """
    rows = url_features(pages, rules, id_col, url_col)
    counts = {r.label: r.n for r in rows.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}
    judged = F.when(F.col("label").isNotNull(), F.when(F.col("label") == 1, "block").otherwise("allow"))
    if len(counts) < 2:
        return rows.select(
            F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(judged, F.lit("allow")).alias("verdict"), F.lit(0.0).alias("block_score")
        )
    scored = _trained(rows, **options).transform(_assembler().transform(rows)).withColumn("block_score", vector_to_array("probability")[1])
    return scored.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce(judged, F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "block_score",
    )
