"""Expressions that several parts of a rule read are worked out once, and words are counted where their text is."""

import pytest
from pyspark.sql import functions as F

from quillsieve.functions import metrics as M
from quillsieve.functions import text as T
from quillsieve.operators import curation, evaluate
from quillsieve.plans import unit_queries


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("a, b. c", "en")], "text string, lang string")


def plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize(
    ("rule", "part", "most"),
    [
        (lambda: T.normalize_sentences(T.strip_orphan_commas("text")), "array_join", 2),  # one for either rule
        (lambda: T.residual_commas("text"), "arrays_zip", 1),
        (lambda: T.function_word_language("text", "lang"), "lower(", 1),
        (lambda: M.flesch("text", "lang"), "regexp_extract_all", 2),  # words, and words of sentences
        (lambda: M.run_on_rate("text"), "regexp_extract_all", 1),
        (lambda: M.immediate_repetitions(T.words("text")), "regexp_extract_all", 1),
        (lambda: curation.select_chunks(curation.split_chunks("text")), "aggregate(", 1),
        (lambda: curation.parse_reply("text"), "try_parse_json", 1),
    ],
)
def test_parts_are_worked_out_once(rows, rule, part, most):
    seen = plan(rows.select(rule().alias("v"))).splitlines()[0]
    found = seen.count(part) or seen.replace("parse_json", "try_parse_json").count(part)
    assert 1 <= found <= most


def test_words_are_counted_beside_their_texts(spark, rows, sf_dir):
    pairs = spark.createDataFrame([(1, "né Äh. the the cat", "the cat cat", "pt"), (2, "um", "x", "en"), (3, None, None, None)], "id int, raw string, new string, lang string")
    kept = evaluate.content_retention(pairs, "id", "raw", "new", "lang")
    assert "explode" not in plan(kept)
    assert {r.id: r.retention for r in kept.collect()} == {1: 2 / 3, 2: 1.0, 3: 1.0}  # ah, as äh folds to, is a hesitation too
    assert "explode" not in plan(unit_queries.se2_shared_words(spark, sf_dir))


@pytest.mark.parametrize("window", [1, 3, 50])
def test_moving_diversity_equals_its_windows(window):
    for words in (list("abcabcaab") * 9, ["x"] * 70, list("ab"), []):
        sets = [len(set(words[k : k + window])) for k in range(len(words) - window + 1)]
        plain = sum(sets) / (window * len(sets)) if sets else len(set(words)) / len(words) if words else 0.0
        assert M._moving_diversity(words, window) == pytest.approx(plain)
