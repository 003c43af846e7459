"""Work that was unbounded or silently short: bands, alignment, exact tails and concurrent calls, each against a plain version."""

import math
import random
import threading
import time
from difflib import SequenceMatcher
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsieve.operators import alignment, curation, dedup, evaluate
from quillsieve.operators.calls import RateLimit, in_flight
from quillsieve.operators.punctuation import restore_punctuation, rule_completer


@pytest.mark.parametrize("threshold", [0.2, 0.3, 0.5, 0.6, 0.8, 0.95])
def test_minhash_recall_at_every_threshold(spark, threshold):
    """300 pairs just over the threshold, of 3 to 300 grams."""
    rng = random.Random(int(threshold * 100))
    docs, want = [], 0
    for k in range(300):
        size = rng.choice([3, 10, 40, 120, 300])
        both = math.ceil(size * threshold + 1e-9)
        a, b = (size - both + 1) // 2, (size - both) // 2  # both / size is the similarity
        shared = [f"{k}s{i}" for i in range(both)]
        docs += [(f"{k}a", "", [*shared, *(f"{k}a{i}" for i in range(a))]), (f"{k}b", "", [*shared, *(f"{k}b{i}" for i in range(b))])]
        want += 1
    rows = spark.createDataFrame(docs, "key string, scope string, words array<string>")
    got = dedup.near_links(rows, dedup.DedupOptions(threshold=threshold, ngram=1, method="minhash"))
    assert got.count() >= 0.9 * want and got.where(F.expr("substr(src, 1, length(src) - 1) <> substr(dst, 1, length(dst) - 1)")).count() == 0


def test_bands_follow_the_threshold():
    chosen = [dedup.bands_for(t) for t in (0.1, 0.2, 0.3, 0.5, 0.8, 0.95)]
    assert all(b * r <= 128 and 1 - (1 - t**r) ** b >= 0.95 for (b, r), t in zip(chosen, (0.1, 0.2, 0.3, 0.5, 0.8, 0.95), strict=True))
    assert [r for _, r in chosen] == sorted(r for _, r in chosen) and chosen[0][1] < chosen[-1][1]
    with pytest.raises(ValueError, match="exact method"):
        dedup.bands_for(0.001)


def test_one_permutation_agrees_as_often_as_sets_are_similar():
    rng = np.random.default_rng(4)
    order = np.argsort(np.random.default_rng(128).random((128, 128)), axis=1)
    for size, both in ((4, 2), (30, 24), (400, 120)):
        agree = []
        for _ in range(150):
            x = rng.integers(-(2**63), 2**63 - 1, 2 * size - both)
            agree.append((dedup.one_permutation(x[:size], order) == dedup.one_permutation(x[size - both :], order)).mean())
        assert abs(np.mean(agree) - both / (2 * size - both)) < 0.05


def test_a_hot_probe_is_linked_by_stars(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    docs = [(f"{k:04}", "", [*base[:55], *(rng.choice(base) for _ in range(2))]) for k in range(300)]
    docs += [(f"x{k}", "", [f"{k}q{i}" for i in range(40)]) for k in range(50)]
    rows = spark.createDataFrame(docs, "key string, scope string, words array<string>")
    for options in (dedup.DedupOptions(threshold=0.8), dedup.DedupOptions(threshold=0.8, method="minhash")):
        links = dedup.near_links(rows, options).collect()
        assert len({k for r in links for k in r}) == 300 and len(links) < 8 * 350  # all pairs are 44,850


def test_marks_never_part_similar_sets_and_tell_most_others():
    rng = np.random.default_rng(9)
    told = 0
    for size in (1, 3, 17, 200, 3000):
        for other in (size, max(1, size // 2), 2 * size):
            for share in (0.0, 0.3, 0.5, 0.8, 1.0):
                both = int(min(size, other) * share)
                x = rng.integers(-(2**63), 2**63 - 1, size + other - both)
                a, b = x[:size], x[size - both :]
                least = dedup.least_apart(dedup.parity_bits(a), dedup.parity_bits(b))
                assert least <= size + other - 2 * both and least == dedup.least_apart(dedup.parity_bits(b), dedup.parity_bits(a))
                told += size == other >= 17 and share < 0.5 and least > (size + other) / 3
    assert told >= 6 and len(dedup.parity_bits(x)) <= 8 * len(x)


def test_only_sets_of_pairs_are_shuffled(spark):
    sets = spark.range(5000).select(F.col("id").alias("key"), F.array("id").alias("grams"))
    keys = spark.range(0, 5000, 100).select(F.col("id").alias("key"))
    left = {r.key for r in dedup._of_keys(sets, keys, 50).collect()}
    assert set(range(0, 5000, 100)) <= left and len(left) < 500
    assert not dedup._of_keys(sets, keys.limit(0), 0).count()


def test_copies_are_one_node_and_scopes_stay_apart(spark):
    base = " ".join(a + b for a in "abcdef" for b in "vwxyz")
    rows = [(k, "x" if k % 2 else "y", base) for k in range(200)] + [(k, "x", base + " more") for k in (500, 501)] + [(900, "x", "!!")]
    docs = spark.createDataFrame(rows, "id long, source string, text string")
    found = dedup.text_groups(docs, "id", "text", ["source"])
    assert dedup.gram_sets(found.dropDuplicates(["key"]).select("key", F.col("_s_source").alias("scope"), F.array(F.lit("a")).alias("words")), 3).count() == 3
    assert sorted(r["count"] for r in found.groupBy("root").count().collect()) == [100, 102]


def test_blocks_equal_the_plain_rule(monkeypatch):
    rng = random.Random(0)
    for turn in range(600):
        monkeypatch.setattr(alignment, "_SMALL", rng.choice([0, 0, 30, 400]))
        words = "abcdefghijklmnopqrstuvwxyzABCDEF"[: rng.choice([1, 2, 3, 6, 32])]
        a = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        b = [rng.choice(words) for _ in range(rng.randint(0, 60))] if turn % 2 else [x for x in a if rng.random() < 0.8]
        plain = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
        assert alignment.matching_words(a, b) == [(i + k, j + k) for i, j, n in plain for k in range(n)]
    assert alignment.matching_words(["", "a", ""], ["", "", "a"]) == [(1, 2)]


def test_blocks_of_long_repeats_take_no_quadratic_time():
    n = 20_000
    rng = random.Random(1)
    few = [str(rng.randint(0, 50)) for _ in range(2 * n)]
    for a, b in ((["x"] * n, ["x"] * n), (["x"] * n, ["x", "y"] * (n // 2)), (["x", "x", "z"] * (n // 3), ["x", "x", "y"] * (n // 3)), (few[:n], few[n:])):
        began = time.perf_counter()
        assert alignment.matching_blocks(a, b)
        assert time.perf_counter() - began < 1.0


def test_the_sign_test_is_exact_and_takes_any_n():
    for n in (1, 2, 7, 30, 101, 1000, 2000):
        for w in range(0, n + 1, max(1, n // 23)):
            k = min(w, n - w)
            plain = 1.0 if 2 * k == n else min(1.0, float(Fraction(2 * sum(math.comb(n, i) for i in range(k + 1)), 2**n)))
            assert evaluate.even_odds_p(w, n) == pytest.approx(plain, rel=1e-11, abs=1e-290)
    began = time.perf_counter()
    normal = math.erfc(19_999 / math.sqrt(2 * 10**9))
    assert evaluate.even_odds_p(500_010_000, 10**9) == pytest.approx(normal, rel=1e-6) and time.perf_counter() - began < 0.5
    assert evaluate.even_odds_p(0, 0) == 1.0


def test_calls_fly_in_a_window_in_order_and_again():
    at_once, most, lock, tries = 0, 0, threading.Lock(), {}

    def call(x):
        nonlocal at_once, most
        with lock:
            at_once += 1
            most = max(most, at_once)
            tries[x] = tries.get(x, 0) + 1
        time.sleep(0.02 if x % 2 else 0.001)
        with lock:
            at_once -= 1
        if x == 13 or (x == 5 and tries[x] == 1):
            raise RuntimeError("busy")
        return x * x

    assert list(in_flight(range(40), call, window=6, attempts=2)) == [None if x == 13 else x * x for x in range(40)]
    assert most == 6 and tries[5] == tries[13] == 2
    taken = []
    answers = in_flight((taken.append(x) or x for x in range(100)), lambda x: x, window=4)
    assert next(answers) == 0 and len(taken) == 4


def test_calls_keep_their_rate():
    began = time.perf_counter()
    assert list(in_flight(range(8), lambda x: x, window=8, rate=RateLimit(f"test {began}", 20.0))) == list(range(8))
    assert time.perf_counter() - began >= 7 / 20 - 0.01


def test_judges_and_completers_fly_with_the_same_rows(spark):
    class Slow:
        provider = model = "slow"

        def __call__(self, prompt, run):
            time.sleep(0.05)
            if prompt == "p7":
                raise RuntimeError("down")
            return f"{prompt}/{run}"

    prompts = spark.createDataFrame([(f"p{k}", k % 3) for k in range(24)], "prompt string, run int").coalesce(1)
    began = time.perf_counter()
    curation.ask(prompts.limit(1), [Slow()]).collect()
    idle = time.perf_counter() - began
    began = time.perf_counter()
    got = curation.ask(prompts, [Slow()], window=8, rate=RateLimit("judges", 1e6)).collect()
    assert [r.raw for r in got] == [None if k == 7 else f"p{k}/{k % 3}" for k in range(24)] and [r.prompt for r in got] == [f"p{k}" for k in range(24)]
    assert time.perf_counter() - began < idle + 24 * 0.05
    text = " ".join(f"word{'abcdefgh'[k % 8]}" for k in range(700))
    rows = spark.createDataFrame([(1, text), (2, None), (3, "short"), (4, text)], "id int, t string")
    one, many = (restore_punctuation(rows, rule_completer, "t", window=w).collect() for w in (1, 6))
    assert one == many and one[0].punctuation_restored
