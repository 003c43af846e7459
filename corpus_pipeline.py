"""Documents through toxicity, near-duplicate, repeat, contamination and token stages.

Every stage takes all that its predecessor kept. The first four return the columns of
documents; the last returns, for each document, its id, token ids and decoded text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.llm.common import materialised, table
from quillsieve.llm.contamination import find_leaks
from quillsieve.llm.pieces import encode_pieces
from quillsieve.llm.queries import piece_model
from quillsieve.llm.repeats import remove_repeats
from quillsieve.llm.similar import keep_one_of_similar
from quillsieve.llm.toxicity import toxicity_scores, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores 0.5 or more; texts without words stay."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return toxicity_scores(docs, model, score_col="_score").where("_score < 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of texts linked by a Jaccard similarity of 0.8 of their five-word shingles."""
    return keep_one_of_similar(docs, words=5, similarity=0.8).select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated 100-byte strings out of the texts; a character that is cut in part goes whole."""
    kept = remove_repeats(docs, keep=COLUMNS, decode=True).withColumn("text", F.when(F.size("spans") == 0, F.col("text")).otherwise(F.col("kept_text")))
    return kept.withColumn("n_chars", F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.length("text"))).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return find_leaks(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS).where(F.size("leaks") == 0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of each document."""
    return encode_pieces(docs, piece_model(), keep=["doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeats),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", tokens),
]
#: The stages learn a model, link texts and encode tokens, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialised(docs)
    return docs
