import random
import zlib

import numpy as np

from quillsieve.llm import language, queries
from quillsieve.llm.language import LanguageModel, cluster_directions, gram_counts, identify, train

SYLLABLES = {"xa": "ka lo mi ne", "xb": "ztr pfl ung sch", "el": "και το νερ ω", "ru": "при вет до мо"}


def made(lang, rng, words):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(words))


def test_op13_is_right_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op13_language_id(spark, sf).collect()
    assert len(got) == len(truth) and {r.lang_pred for r in got} <= set(truth.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    own = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in own) / len(own) > 0.98


def test_languages_of_any_script_and_rejection_of_others(spark):
    rng = random.Random(3)
    rows = [(k, made(lang, rng, rng.randint(20, 80)), lang) for lang in SYLLABLES for k in range(400)]
    model = train(spark.createDataFrame(rows, "doc_id int, text string, lang string"), dims=2048, sample=400)
    assert sorted(set(model.languages)) == sorted(SYLLABLES) and len(model.languages) <= 16
    fresh = [(k, made(lang, rng, 40), lang) for lang in SYLLABLES for k in range(30)] + [(99, "你好世界" * 30, "zh")]
    got = identify(spark.createDataFrame(fresh, "doc_id int, text string, lang string"), model).collect()
    own = [r for r in got if r.lang != "zh"]
    assert all(r.lang_pred in (r.lang, language.UNKNOWN) for r in own) and sum(r.rejected for r in own) <= 6
    assert [r.lang_pred for r in got if r.lang == "zh"] == [language.UNKNOWN]


def test_null_empty_long_repeated_and_clashing_rows(spark):
    rows = [(1, "ab cd", "p", "x"), (1, "ab cd", "p", "x"), (2, None, "p", "x"), (3, "", "q", "x"), (None, "zz yy", "q", "x"), (4, "ab " * 100_000, None, "x"), (5, "12 ½ !!", "p", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = identify(docs, train(docs, dims=256), reject=False)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    by = {(r.doc_id, r.text and r.text[:2]): r for r in got.collect()}
    assert got.count() == 7 and by[4, "ab"].lang_pred == "p" and by[None, "zz"].lang_pred == "q"
    assert {by[k].lang_pred for k in ((2, None), (3, ""), (5, "12"))} == {language.UNKNOWN} and by[2, None].score == 0
    none = identify(docs, train(docs.limit(0)))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {(language.UNKNOWN, 0.0)}
    assert identify(docs.limit(0), train(docs)).collect() == []


def test_blocks_count_as_the_whole(monkeypatch):
    text = "Añb ÇD e1fé " * 300
    want = gram_counts(text, 4096)
    monkeypatch.setattr(language, "_BLOCK", 17)
    assert (gram_counts(text, 4096) == want).all() and gram_counts("4 5 _", 16) is None
    letters = "añb çd e fé " * 300
    assert want.sum() == 3 * (len(letters) + 1) - 3


def test_cosines_equal_a_plain_nearest_centroid():
    rng = np.random.default_rng(2)
    x = rng.random((60, 32)) + np.repeat(np.eye(32)[:3] * 9, 20, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cents, own = cluster_directions(x, 3)
    assert len({tuple(own[k : k + 20]) for k in (0, 20, 40)}) == 3 and all(len(set(own[k : k + 20])) == 1 for k in (0, 20, 40))
    model = LanguageModel(np.ones(64), ["a", "b"], np.stack([language.weighed(gram_counts(t, 64), np.ones(64)) and np.zeros(64) for t in "ab"]), np.ones((2, 4)))
    for k, t in enumerate(("aaa bb", "xyz qq")):
        at, value = language.weighed(gram_counts(t, 64), model.idf)
        model.centroids[k, at] = value
    assert model.predict("aaa bb")[0] == "a" and abs(model.predict("xyz qq")[1] - 1) < 1e-9
