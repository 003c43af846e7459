import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillsieve.llm import queries
from quillsieve.llm.lmscore import cross_entropy_difference, packed, unpacked, words_of
from quillsieve.llm.toxicity import ToxicityModel, fit, toxicity_scores, train
from quillsieve.llm.urls import UrlRule, held_out_auc, url_features, url_verdicts

TEXT = "The quick brown fox jumps over the lazy dog while a small bird sings near an old mill and nobody listens to it at all today."


# toxicity


def test_op3_is_right_on_held_out_documents(spark, sf_dir):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op3_toxicity(spark, sf).collect()
    own = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in own) / len(own) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_counterfactual_penalty_lowers_the_gap_of_group_mentions():
    rng = random.Random(7)
    filler = [f"w{k}" for k in range(60)]
    texts, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        words = set(rng.sample(filler, 12)) | ({rng.choice(["awful", "vile"])} if toxic else set())
        if rng.random() < (0.7 if toxic else 0.1):
            words.add("muslim")
        if rng.random() < 0.1:
            words.add("christian")
        texts.append(words)
        labels.append(int(toxic))
    column = {w: k for k, w in enumerate([*filler, "awful", "vile", "muslim", "christian"])}
    row, col = np.array([(k, column[w]) for k, words in enumerate(texts) for w in sorted(words)]).T
    free, held = (fit(column, row, col, np.array(labels), penalty=p) for p in (0.0, 20.0))
    gap = lambda m: abs(m.score("w1 w2 muslim") - m.score("w1 w2 christian"))
    assert gap(held) < 0.3 * gap(free)
    assert held.score("an awful muslim") > 0.5 > held.score("a neutral muslim w1 w2")


def test_toxicity_on_hard_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (None, "Stupid idiot", 0.1), (4, "x " * 50_000, 0.1), (4, "x", 0.1)], "doc_id long, text string, score double")
    got = toxicity_scores(docs, ToxicityModel(-2.0, {"stupid": 3.0, "idiot": 1.0}))
    assert got.columns == ["doc_id", "text", "score"]
    by_text = {r.text: r.score for r in got.collect()}
    assert math.isclose(by_text["Stupid idiot"], 1 / (1 + math.exp(-2))) and by_text[None] == by_text[""] == by_text["x"]
    labels = spark.createDataFrame([(1, 1, None), (2, None, None), (None, 1, None)], "doc_id long, toxic int, text string")
    assert 0 < train(docs, labels).score("x") < 1
    assert train(docs.limit(0), labels.limit(0)).score(None) == 0.5


# urls


def plain_rule(rules, url):
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.pattern), default=None)
    return host, path, best


@pytest.mark.parametrize("rules", [queries.URL_RULES, [UrlRule("allow", "com/")]])
def test_url_rules_equal_brute_force(spark, sf_dir, rules):
    odd = [None, "", "no scheme", "http://", "HTTP://A.Example.COM:80/EN/7?x#y", "http://example.com/en/7?a=1", "http://com/en/", "https://x.net/de/8#a/b", "http://xcom/en/1", "a://b://c/d?e://f", "http://é.org/es/" + "x" * 9000]
    urls = [r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()] + odd + odd[:2]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_verdicts(pages, rules).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule = plain_rule(rules, urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule.pattern if rule else None)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")
    assert url_verdicts(pages.limit(0), rules).count() == 0


def test_trees_learn_what_the_rules_show(spark):
    rng = random.Random(8)
    urls = [f"http://s{k % 9}.good.com/a/{rng.randint(1, 99)}" for k in range(300)]
    urls += [f"http://s{k % 9}.bad.net/{'x-' * 9}{rng.randint(10**8, 10**9)}?a=1&b=2&c=3" for k in range(300)]
    urls += ["http://new.org/a/7", "http://new.org/" + "x-" * 9 + "123456789?a=1&b=2&c=3"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_verdicts(pages, [UrlRule("allow", "good.com/"), UrlRule("block", "bad.net/")]).collect()}
    assert got[600].block_score < got[601].block_score and got[601].verdict == "block"


def test_no_label_is_a_feature_of_its_own_url_and_held_out_urls_are_told_apart(spark):
    pages = spark.createDataFrame([(1, "http://a.good.com/x"), (2, "http://b.bad.net/x"), (3, "http://b.bad.net/x"), (4, "http://c.org/y")], "page_id long, url string")
    rows = {r.id: r for r in url_features(pages, [UrlRule("allow", "good.com/"), UrlRule("block", "bad.net/")]).collect()}
    assert rows[1].suffix_blocked == rows[2].suffix_blocked == rows[3].suffix_blocked == 0.5 and rows[4].label is None
    found = url_features(queries.table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url"), queries.URL_RULES)
    assert held_out_auc(found) > 0.7


# language-model scores


@pytest.mark.parametrize("options", [{}, {"block_bytes": 40, "bucket_keys": 1, "most_broadcast": 0}])
def test_cross_entropy_difference_equals_a_plain_model(spark, options):
    texts = {1: "The cat sat. The cat ran!", 2: "a dog ran", 3: "", 4: None, 5: "the the the cat", 6: "the cat sat", 7: " ... \n!", 8: "x" * 500 + " été"}
    docs = spark.createDataFrame([(k, t, 0.0) for k, t in texts.items()] + [(6, texts[6], 0.0), (None, "dog", 0.0)], "doc_id long, text string, score double")
    targets = spark.createDataFrame([(1, "x"), (6, "y"), (6, "z"), (None, "n")], "doc_id long, text string")
    every = [(i, words_of((t or "").encode())) for i, t in [*texts.items(), (6, texts[6]), (None, "dog")]]
    size = len({w for _, ws in every for w in ws}) + 1
    raw = [*texts.values(), texts[6], "dog"]

    def models(text):
        """Pairs, words and the weight of both models, counted without the rows of ``text``."""
        pairs, words = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}
        for (i, ws), other in zip(every, raw, strict=True):
            for kind in (False, True):
                if ws and other != text and (not kind or i in (1, 6)):
                    pairs[kind].update(zip([b"", *ws], [*ws, b""], strict=True))
                    words[kind].update([*ws, b""])
        return pairs, words, {True: 1, False: words[True].total() / words[False].total()}

    def p(model, kind, u, v):
        pairs, words, weight = model
        w = weight[kind]
        return (w * pairs[kind][u, v] + 50 * (w * words[kind][v] + 1) / (words[True].total() + size)) / (w * words[kind][u] + 50)

    want = sorted(
        (i or 0, len(ws), *(-sum(math.log(p(models(text), k, u, v)) for u, v in zip([b"", *ws], [*ws, b""], strict=True)) / (len(ws) + 1) for k in (True, False)))
        for (i, ws), text in zip(every, raw, strict=True)
        if ws
    )
    found = cross_entropy_difference(docs, targets, **options)
    got = sorted((r.doc_id or 0, r.n_tokens, r.target_loss, r.background_loss) for r in found.collect() if r.n_tokens)
    assert np.allclose(got, want)
    assert all(math.isclose(sum(p(models("a dog ran"), k, b"the", v) for v in {w for _, ws in every for w in ws} | {b""}), 1) for k in (True, False))
    assert cross_entropy_difference(docs.limit(0), targets.limit(0), **options).count() == 0
    blank = {r.doc_id: (r.n_tokens, r.score) for r in cross_entropy_difference(docs, targets.limit(0), **options).collect()}
    assert blank[3] == blank[4] == blank[7] == (0, None) and blank[1][1] == 0


@pytest.mark.parametrize("most", [0, 100])
def test_a_targets_copy_scores_like_its_unlabelled_twin(spark, most):
    texts = ["red green blue", "red green blue", "red green grey", "one two three", "one two three four", "red green blue"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    targets = spark.createDataFrame([(0,), (2,)], "doc_id long")
    got = {r.doc_id: r.score for r in cross_entropy_difference(docs, targets, most_broadcast=most).collect()}
    assert got[0] == got[1] == got[5] and got[0] < got[3] < got[4] + 1
    alone = cross_entropy_difference(docs.where("doc_id = 3"), docs.where("doc_id = 3"), most_broadcast=most).first()
    assert alone.score == 0 and math.isclose(alone.target_loss, math.log(4))


def test_planes_are_packed_and_unpacked():
    for values in ([], [0], [2**63 + 5, 1, 2**64 - 1]):
        assert unpacked(packed(np.array(values, np.uint64))).tolist() == values


def test_op5_tells_good_documents_apart(spark, sf_dir):
    """The target's own documents score lower than the others, and a row comes for each document."""
    scores = queries.op5_lm_scoring(spark, sf_dir)
    assert scores.count() == queries.table(spark, sf_dir, "documents").count()
    by = dict(scores.where("score is not null").join(queries.table(spark, sf_dir, "labels"), "doc_id").groupBy("quality").avg("score").collect())
    assert by[1] < by[0]
