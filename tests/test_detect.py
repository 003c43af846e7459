"""The n-gram detector: against a plain posterior, in several scripts, and on held-out documents by language and length."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quillsieve.operators.detect import detected_language, fit_profiles, gram_hashes

WORDS = {"xx": "kalo mina tero supa vime", "yy": "kalt mino tura spax vamo", "el": "και νερο θαλασσα μου", "ru": "привет море дом мой", "ja": "これは とても よい ほん"}


def plain_grams(text):
    line = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    return Counter(line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1) if line[i : i + n] != " ")


def made(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def test_posteriors_equal_a_plain_version(spark):
    rng = random.Random(2)
    rows = [(made(rng, lang, rng.randint(3, 20)), lang) for lang in WORDS for _ in range(12 if lang == "xx" else 6)]
    profiles = fit_profiles(spark.createDataFrame([*rows, (None, "xx"), ("kalo", None)], "text string, lang string"), most=10_000)
    counts = {lang: sum((plain_grams(t) for t, x in rows if x == lang), Counter()) for lang in WORDS}
    every = set().union(*counts.values())
    for text in [made(rng, lang, 6) for lang in WORDS] + ["kalo kalt unknownish words mixed"]:
        grams = {g: n for g, n in plain_grams(text).items() if g in every}
        logs = {
            lang: math.log(sum(x == lang for _, x in rows) / len(rows)) + sum(n * math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * len(every))) for g, n in grams.items())
            for lang, c in counts.items()
        }
        chances = {k: math.exp(v - max(logs.values())) for k, v in logs.items()}
        got = dict(zip(profiles.languages, profiles.posterior(text), strict=True))
        assert all(abs(got[k] - v / sum(chances.values())) < 1e-9 for k, v in chances.items())


def test_scripts_fallbacks_and_odd_rows(spark):
    rng = random.Random(3)
    profiles = fit_profiles(spark.createDataFrame([(made(rng, lang, 30), lang) for lang in WORDS for _ in range(20)], "text string, lang string"), most=200)
    rows = [(made(rng, lang, 8), lang) for lang in WORDS] + [("four words are few", "fb"), (None, "fb"), ("", "fb"), ("1 2 3 4 5 6", "fb"), ("中 文 字 符 串 吗", "fb"), ("kalo mina " * 40_000, "xx")]
    got = spark.createDataFrame(rows, "t string, want string").select("want", detected_language("t", F.lit("fb"), profiles).alias("d")).collect()
    assert all(r.d.language == r.want for r in got) and all((r.d.chance is None) == (r.want == "fb") for r in got)
    none = fit_profiles(spark.createDataFrame([], "text string, lang string"))
    assert spark.createDataFrame(rows[:1], "t string, want string").select(detected_language("t", F.lit("fb"), none).alias("d")).first().d.language == "fb"


def test_held_out_accuracy_by_language_and_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    profiles = fit_profiles(docs.where("doc_id % 3 <> 1"))
    found = docs.where("doc_id % 3 = 1").select("lang", F.length("text").alias("n"), detected_language("text", F.lit("?"), profiles)["language"].alias("d")).collect()
    for lang in {r.lang for r in found}:
        own = [r for r in found if r.lang == lang and r.d != "?"]
        assert sum(r.d == lang for r in own) / len(own) > 0.97, lang
    for low, high in ((0, 300), (300, 1000), (1000, 10**9)):
        own = [r for r in found if low <= r.n < high and r.d != "?"]
        assert sum(r.d == r.lang for r in own) / len(own) > 0.95, low


def test_blocks_hold_every_gram(monkeypatch):
    from quillsieve.operators import detect

    text = "Ab çde 😀 fé " * 50
    whole = Counter(x for part in gram_hashes(text) for x in part.tolist())
    monkeypatch.setattr(detect, "_BLOCK", 13)
    assert Counter(x for part in gram_hashes(text) for x in part.tolist()) == whole and sum(whole.values()) == sum(plain_grams(text).values())
