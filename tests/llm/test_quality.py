import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillsieve.llm import quality, queries
from quillsieve.llm.quality import _join_arrays, _model_arrays, base_counts, exact_quantiles, kneser_ney, quality_rules, scored_texts, text_grams
from quillsieve.llm.toxicity import held_out

TEXT = "The quick brown fox jumps over the lazy dog while a small bird sings near an old mill and nobody listens to it at all today."


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts_equal_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "é\u00a0x ", "\n", "\t", "## ", "a b c d e f g h ", "\x1c", "\r\n"]) for _ in range(rng.randint(0, 60)))
        assert base_counts(text) == plain_base(text)
    assert base_counts(None) == (0, 0, 0, 0, 0)


class PlainModel:
    """Interpolated modified Kneser-Ney by its definition, over strings."""

    def __init__(self, texts):
        self.grams = {4: Counter(("\0\0\0" + t)[k : k + 4] for t in texts for k in range(len(t)))}
        for n in (3, 2, 1):
            self.grams[n] = Counter(g[1:] for g in self.grams[n + 1])
        self.size = len(self.grams[1]) + 1
        self.by_context = {n: defaultdict(dict) for n in self.grams}
        for n, own in self.grams.items():
            for g, c in own.items():
                self.by_context[n][g[:-1]][g] = c

    def discounts(self, n):
        c = Counter(self.grams[n].values())
        if not all(c[k] for k in (1, 2, 3, 4)):
            return [0, 0.5, 1.0, 1.5]
        y = c[1] / (c[1] + 2 * c[2])
        return [0, *(min(max(k - (k + 1) * y * c[k + 1] / c[k], 0), k) for k in (1, 2, 3))]

    def prob(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / self.size
        own = self.by_context[n].get(gram[:-1])
        if not own:
            return self.prob(gram[1:])
        d, total, c = self.discounts(n), sum(own.values()), self.grams[n][gram]
        return (c - d[min(c, 3)]) / total + sum(d[min(x, 3)] for x in own.values()) / total * self.prob(gram[1:])

    def loss(self, text):
        return -sum(math.log(self.prob(("\0\0\0" + text)[k : k + 4])) for k in range(len(text))) / len(text)


def corpus():
    rng = random.Random(3)
    en = [TEXT, TEXT.upper(), "aaaa bbbb", "x1 y2! ## été"] + [" ".join(rng.choice(TEXT.split()) for _ in range(30)) for _ in range(20)]
    ru = ["быстрая лиса прыгает через пса", "ночь улица фонарь аптека", "лиса и ночь"]
    zh = ["敏捷的棕色狐狸跳过懒狗", "狐狸和狗", "\U0001f600 狐狸"]
    return [(k, t, lang) for k, (t, lang) in enumerate([*((t, "en") for t in en), *((t, "ru") for t in ru), *((t, "zh") for t in zh), ("no language at all", None), ("", "en"), (None, "ru")])]


@pytest.mark.parametrize("options", [{}, {"most_broadcast": 0, "task_chars": 100, "bucket": 300}])
def test_losses_equal_a_plain_model(spark, options):
    """Every script and language has its own model of code points; broadcast and dealt-out models score alike, seen and unseen texts."""
    rows = corpus()
    unseen = [(100, "The zebra quacks: 狐狸 ночь", "en"), (101, "狐狸 fox", "zh"), (102, "ночь", "xx")]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = spark.createDataFrame(rows + unseen, "doc_id long, text string, lang string")
    model = kneser_ney(train, "text", "lang")
    got = {r.id: r.loss for r in scored_texts(docs, model.checkpoint(), "doc_id", "text", "lang", **options).collect()}
    assert len(got) == len(rows) + 3
    plain = {x: PlainModel([t for _, t, lang in rows if (lang or "") == x and t]) for x in ("en", "ru", "zh", "")}
    for i, t, lang in rows + unseen:
        if not t:
            assert got[i] is None
        elif lang == "xx":
            assert got[i] == 0  # no model of that language
        else:
            assert got[i] == pytest.approx(plain[lang or ""].loss(t), rel=1e-5)
    assert got[100] > got[0]


def test_probabilities_sum_to_one(spark):
    rows = corpus()
    model = kneser_ney(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang").where("lang = 'en'").toArrow()
    own = _join_arrays([(r["hashes"], r["values"]) for r in _model_arrays(model).to_pylist()])
    letters = sorted({c for _, t, lang in rows if lang == "en" and t for c in t})
    for context in ("the", "zzz", " qu", "AZY"):
        first, rest = text_grams([context + c for c in letters])
        keep = slice(3, None, 4)
        total = np.exp(own.log_prob(first[keep], rest[keep])).sum()
        unknown = np.exp(own.log_prob(*(x[3:] for x in text_grams([context + "\u4e00"])))).sum()
        assert total + unknown == pytest.approx(1, rel=1e-5)


def test_quantiles_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.random()) for _ in range(400)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    a, b = ({r.k: r.q for r in exact_quantiles(df.repartition(n), ["k"], "v", [0.25, 0.75]).collect()} for n in (1, 7))
    own = sorted(round(v, 3) for k, v in rows if k == "a")
    assert a == b and a["a"] == [own[math.ceil(len(own) * s) - 1] for s in (0.25, 0.75)]


def test_quality_rules_on_hard_rows(spark):
    rng = random.Random(6)
    vocabulary = TEXT.lower().split()
    good = [(k, " ".join(rng.choice(vocabulary) for _ in range(120)), "en", 0.0) for k in range(60)]
    junk = [(100 + k, " ".join("".join(rng.choice("qzxj$%&|") for _ in range(7)) for _ in range(120)), "en", 0.0) for k in range(3)]
    odd = [(200, None, None, None), (201, "", "en", 0.0), (202, "few words", "xx", 0.0), (203, TEXT, None, 0.0), (None, TEXT, "en", 0.0), (0, good[0][1], "en", 0.0), (204, "long words here " * 30_000, "en", 0.0)]
    docs = spark.createDataFrame(good + junk + odd, "doc_id long, text string, lang string, loss double")
    labels = spark.createDataFrame([(k, 1) for k in range(60)] + [(k, 1) for k in range(5)] + [(100, 0), (None, 1), (201, None)], "doc_id long, quality int")
    for given in (None, labels):
        got = quality_rules(docs, given).collect()
        assert len(got) == len(good + junk + odd)
        kept = {r.doc_id for r in got if r.kept}
        assert len(set(range(60)) - kept) <= (0 if given is None else 3) and not kept & {100, 101, 102, 200, 201, 202, 204}
        for r in got:
            if r.doc_id is not None:
                text = next(t for i, t, _, _ in good + junk + odd if i == r.doc_id)
                assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_base(text)
                assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert quality_rules(docs.limit(0), labels.limit(0)).count() == 0
    assert quality_rules(docs, labels.limit(0)).count() == len(good + junk + odd)


def test_held_out_junk_goes_and_good_texts_stay(spark):
    sf = "/root/testdata/sf0.01"
    own = queries.op2_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where(held_out("doc_id") & ~queries.F.col("base_failed")).collect()
    junk, good = ([r.kept for r in own if r.quality == q] for q in (0, 1))
    assert sum(good) >= 0.95 * len(good) and sum(junk) <= 0.25 * len(junk)


def test_packed_grams_come_back_and_are_few_bytes():
    text = "a quarrel of sparrows in the ßtraße, \U0001f426 again and again. " * 50
    first, rest, _, n = quality._distinct(*quality.text_grams([text, "b"]))
    packed = quality.packed_grams(first, rest, n)
    got = {(a, b): c for a, b, c in zip(*(x.tolist() for x in quality.unpacked_grams(packed)), strict=True)}
    assert got == {(a, b): c for a, b, c in zip(first.tolist(), rest.tolist(), n.tolist(), strict=True)} and sum(got.values()) == len(text) + 1


def test_grams_of_all_tasks_are_counted_in_packed_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "_MOST_HELD", 40)
    texts = [f"some words {k} and other words" for k in range(60)]
    batch = quality.pa.RecordBatch.from_pydict({"lang": ["en"] * 60, "text": texts})
    sent = list(quality._counted(iter([batch.slice(0, 20), batch.slice(20, 40)])))
    assert all(b.schema.names == ["lang", "part", "grams"] for b in sent)
    got = Counter()
    for b in sent:
        for packed in b.column("grams").to_pylist():
            for a, r, c in zip(*quality.unpacked_grams(packed), strict=True):
                got[int(a), int(r)] += int(c)
    first, rest = quality.text_grams(texts)
    assert got == Counter(zip(first.tolist(), rest.tolist(), strict=True))


def test_rows_are_picked_by_id_without_a_shuffle_of_texts(spark):
    ids = [-40_000, -1, 0, 5, 32_767, 32_768, 10**12, None]
    docs = spark.createDataFrame([(k, "t") for k in [*ids, 1, 6, 32_769, -2, 10**12 + 1]], "id long, text string")
    wanted = spark.createDataFrame([(k,) for k in ids], "w long")
    for picked in (quality.rows_among(docs, "id", wanted), quality.rows_among(docs, "id", wanted, most_parts=2)):
        assert {r.id for r in picked.collect()} == set(ids) - {None}
    assert "Exchange" not in quality.rows_among(docs, "id", wanted)._jdf.queryExecution().toString()
    assert not quality.rows_among(docs, "id", wanted.limit(0)).count()
