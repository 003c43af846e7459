"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.llm import audit, centroids, language, licenses
from quillsieve.llm.common import spread, table
from quillsieve.llm.contamination import find_leaks
from quillsieve.llm.lmscore import cross_entropy_difference
from quillsieve.llm.pieces import encode_pieces
from quillsieve.llm.quality import quality_rules
from quillsieve.llm.repeats import remove_repeats
from quillsieve.llm.simhash import simhash_components
from quillsieve.llm.toxicity import held_out, toxicity_scores, train
from quillsieve.llm.unigram import fit_scores, token_counts, vocabulary
from quillsieve.llm.urls import UrlRule, url_verdicts

URL_RULES = [
    UrlRule("block", "com/en/"),
    UrlRule("allow", "example.com/en/7"),
    UrlRule("allow", "net/de/"),
    UrlRule("block", "example.net/de/8"),
    UrlRule("block", "org/es/"),
]


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spread(table(spark, sf_dir, "documents")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity_scores(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy_difference(spread(table(spark, sf_dir, "documents")), good)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spread(table(spark, sf_dir, "documents")))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def piece_model() -> str:
    """The public model file that the token queries use."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_pieces(spread(table(spark, sf_dir, "documents")), piece_model(), keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").cast("long").alias("n_items"),
        F.col("leaks.item_id").alias("item_ids"),
        F.array_min("leaks.distance").alias("least_distance"),
    )


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(spread(table(spark, sf_dir, "documents")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    scores, _ = fit_scores(docs, vocabulary(piece_model()))
    return token_counts(docs, scores, keep=["doc_id"])


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(spread(table(spark, sf_dir, "embeddings")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_interactions(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts beyond every radius still get their nearest language here, as each text with a letter must; ``rejected`` marks them."""
    docs = spread(table(spark, sf_dir, "documents"))
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))
    model = language.train(docs.where(~F.col("held_out")))
    return language.identify(docs, model, keep=["doc_id", "held_out"], reject=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_simhash_near_dedup,
        op2_quality_rules,
        op3_toxicity,
        op4_url_filters,
        op5_lm_scoring,
        op6_suffix_array_dedup,
        op7_sentencepiece,
        op8_benchmark_decontamination,
        op9_license_scans,
        op10_token_counts,
        op11_centroid_clustering,
        op12_filter_audit,
        op13_language_id,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op9_license_scans": licenses.oracle(), "op11_centroid_clustering": centroids.oracle(), "op12_filter_audit": audit.oracle()}
