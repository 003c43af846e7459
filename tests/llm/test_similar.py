import random

import pytest

import corpus_pipeline
from quillsieve.llm.similar import shingle_sketch, shingles, similar_components


def plain_sets(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def plain_roots(docs):
    """The least id that links of exact Jaccard 0.8 or of equal words reach, by all pairs."""
    sets = {i: plain_sets(t) for i, t in docs if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(150)] for _ in range(6)]
    line = [rng.choice(words) for _ in range(20)]
    rows = []
    for i in range(160):
        own = list(rng.choice(base)) if i % 2 else [rng.choice(words) for _ in range(120)]
        for _ in range(rng.randint(0, 7)):
            own[rng.randrange(len(own))] = "new" + str(rng.randint(0, 10**6))
        rows.append((i, " ".join(line + own if i % 3 else own)))
    return [*rows, (300, None), (301, " \n"), (302, "a b"), (303, "A  b"), (304, "a c"), (None, rows[1][1]), (305, rows[1][1].upper())]


@pytest.mark.parametrize("options", [{}, {"most_stars": 0}, {"most_pairs": 0, "most_broadcast": 0}])
def test_components_equal_all_pairs(spark, texts, options):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    want = plain_roots(texts)
    got = {i: i for i in want} | {r.node: r.root for r in similar_components(docs, **options).collect()}
    assert got == want and len(set(want.values())) < len(want) - 20
    assert similar_components(docs.limit(0)).count() == 0


def test_sketch_counts_every_text(spark, texts):
    rows = spark.createDataFrame([(i, (t or "").encode()) for i, t in texts], "id long, raw binary").repartition(4)
    want = sum((list(shingles((t or "").encode())) for _, t in texts), [])
    got = shingle_sketch(rows, 5)
    assert got.sum() == len(want) and all(got[int(g) % len(got)] for g in want)


def test_stage_drops_every_copy_of_similarity_08(spark):
    """Copies of Jaccard 0.8 to 0.9 mostly differ in more than 4 bits of SimHash."""
    rng = random.Random(12)
    rows = []
    for k in range(20):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(204)]
        copy = list(words)
        for at in (20, 70, 120, 170):
            copy[at] = "changed"
        rows += [(2 * k, " ".join(words), "en", "s", 0), (2 * k + 1, " ".join(copy), "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [2 * k for k in range(20)]
