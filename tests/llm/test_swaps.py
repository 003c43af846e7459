import math
import random

import numpy as np

from quillsieve.llm.toxicity import fit, shared_beginnings, train

FILLER = ["".join(random.Random(k).choices("bcdfghklmnprstvz", k=3)) for k in range(60)]


def logit(model, text):
    p = model.score(text)
    return math.log(p / (1 - p))


def test_swapping_a_long_term_moves_the_score_no_more_through_its_beginning(spark):
    rng = random.Random(13)
    rows, labels = [], []
    for k in range(1, 1501):
        toxic = k % 4 == 0
        words = rng.sample(FILLER, 12) + ([rng.choice(["awful", "vile"])] if toxic and rng.random() < 0.8 else [])
        if rng.random() < (0.7 if toxic else 0.1):
            words.append("muslim")
        if rng.random() < 0.1:
            words.append("christian")
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    free, held = (train(docs, known, penalty=p) for p in (0.0, 20.0))
    assert free.weights.get("musl*", 0) > 0.5
    text = " ".join(FILLER[:5])
    gap = lambda m: abs(logit(m, text + " muslim") - logit(m, text + " christian"))
    assert gap(held) < 0.2 * gap(free)
    assert held.score("an awful muslim") > 0.5 > held.score(text + " muslim")


def test_a_beginning_that_another_word_has_stays():
    assert shared_beginnings("Muslim muslims muslim christian") == {"musl*"} and shared_beginnings(None) == set()
    column = {"muslim": 0, "musl*": 1, "christian": 2, "x": 3}
    row, col = np.array([0, 0, 1, 2, 2, 3]), np.array([0, 1, 3, 0, 1, 3])
    labels = np.array([1, 0, 1, 0])
    gone, stays = (fit(column, row, col, labels, penalty=1000.0, staying=s) for s in (frozenset(), frozenset({(0, 1), (2, 1)})))
    change = lambda m, *words: m.weights.get("christian", 0) - sum(m.weights.get(w, 0) for w in words)
    assert abs(change(gone, "muslim", "musl*")) < 0.05 and abs(change(stays, "muslim")) < 0.05 < abs(stays.weights["musl*"])


def test_scores_of_swapped_mentions_are_close(spark):
    """A term that goes with label 1 in 80 of 100 texts: without the penalty its mentions score far apart, with it within 0.05."""
    rng = random.Random(1)
    docs, known = [], []
    for k in range(400):
        term = "muslims" if (rng.random() < 0.8) == bool(k % 2) else "christians"
        docs.append((k, f"the {term} came " + " ".join(rng.choice(["tree", "road", "river", "stone"]) for _ in range(6))))
        known.append((k, k % 2))
    docs, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, toxic int")
    gap = lambda m: abs(m.score("the muslims came") - m.score("the christians came"))
    assert gap(train(docs, known, penalty=0.0)) > 0.5 and gap(train(docs, known)) < 0.05


def test_neutral_mentions_are_no_false_positives(spark):
    """Held-out neutral sentences with a term that stands mostly in toxic texts: fewer of them are called toxic than without the penalty."""
    rng = random.Random(2)
    docs, known = [], []
    for k in range(1200):
        toxic = k % 3 == 0
        words = rng.sample(FILLER, 8) + (["vile"] if toxic and rng.random() < 0.7 else []) + (["women"] if rng.random() < (0.8 if toxic else 0.15) else []) + (["men"] if rng.random() < 0.15 else [])
        docs.append((k, " ".join(words)))
        known.append((k, int(toxic)))
    docs, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(known, "doc_id long, toxic int")
    neutral = [" ".join(rng.sample(FILLER, 8)) + " women" for _ in range(200)]
    models = {p: train(docs, known, penalty=p) for p in (0.0, 20.0)}
    wrong = {p: sum(m.score(t) >= 0.5 for t in neutral) / 200 for p, m in models.items()}
    assert wrong[20.0] < 0.05 < wrong[0.0]


def test_the_fit_minimises_its_objective():
    """Against the objective written out plainly: no small step in any direction lowers it by more than the steps' rest."""
    rng = random.Random(3)
    column = {"women": 0, "wome*": 1, "men": 2, "vile": 3, "x": 4}
    texts = [sorted({0, 1} if rng.random() < 0.5 else {2}) + [3] * (rng.random() < 0.4) + [4] * (rng.random() < 0.5) for _ in range(80)]
    labels = np.array([int(3 in t or (0 in t and rng.random() < 0.7)) for t in texts])
    row, col = np.array([(r, c) for r, t in enumerate(texts) for c in t]).T
    model = fit(column, row, col, labels, penalty=20.0, steps=4000, rate=0.02)

    def objective(w, bias):
        score = lambda t: 1 / (1 + math.exp(-(bias + sum(w[c] for c in t))))
        ones = labels.sum()
        loss = sum(-(0.5 * len(texts) / ones) * math.log(score(t)) if y else -(0.5 * len(texts) / (len(texts) - ones)) * math.log(1 - score(t)) for t, y in zip(texts, labels, strict=True)) / len(texts)
        swaps = [(t, [c for c in t if c not in (0, 1)] + [2]) if 0 in t else (t, [c for c in t if c != 2] + [0, 1]) for t in texts for _ in (1, 2)]
        return loss + 2e-4 / 2 * sum(x * x for x in w) + 20.0 * sum((score(a) - score(b)) ** 2 for a, b in swaps) / len(swaps)

    w = [model.weights.get(x, 0.0) for x in column]
    best = objective(w, model.bias)
    for k in range(6):
        for step in (-0.05, 0.05):
            moved = list(w)
            if k < 5:
                moved[k] += step
            assert objective(moved, model.bias + (step if k == 5 else 0)) > best - 1e-5
