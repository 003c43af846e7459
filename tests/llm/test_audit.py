import itertools
import re

import numpy as np
from pyspark.sql import functions as F

from quillsieve.llm.audit import duplicate_sketch, filter_interactions, first_copies, may_repeat, sketch_size

LONG = " ".join(f"w{k}" for k in range(220))


def plain_audit(docs, labels):
    """Each of the 120 orders applied to each document, one after the other."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        f += "E" * (i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs))
        fails.append((source or "", set(f), i in good, i in toxic))
    found, removed = {}, {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {p for p, *_ in fails}:
            left = [r for r in fails if r[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                out = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                found[part, order, step] = [len(left), len(out), sum(x in r[1] for r in gone), sum(r[0] == part and r[1] == {x} for r in fails), sum(r[2] for r in out), sum(r[3] for r in out)]
                removed[part, x] = removed.get((part, x), 0) + len(out)
                gone += out
    return {(*k, *v, removed[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def test_audit_equals_every_order_applied(spark):
    docs = [
        (1, LONG, "a"), (2, LONG, "b"), (3, LONG, "a"), (4, None, "a"), (5, "", None), (6, "AB# " * 300, ""), (7, "x y z", "b"), (7, "x y z", "b"), (8, "x y z", "a"),
        (None, "x y z", "a"), (None, LONG, "a"), (9, "a " * 100_000, "b"), (10, "a  " * 250 + "|", "b"), (3, "other", "a"), (2, "other", "b"), (11, "ß" * 49 + "Q", "c"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (3, None, 1), (3, 1, None), (6, 0, 0), (None, 1, 1), (9, 1, 1), (11, 1, 0)]
    rows = spark.createDataFrame([(*d, "junk", 3) for d in docs], "doc_id long, text string, source string, mask string, first_id int").repartition(3)
    marks = spark.createDataFrame([(*x, "junk") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = filter_interactions(rows, marks).collect()
    assert len(got) == 600 * 4
    assert {tuple(r) for r in got} == plain_audit(docs, labels)


def test_audit_of_no_documents_and_no_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_interactions(docs, labels).collect() == []
    one = spark.createDataFrame([(1, LONG, "s")], docs.schema)
    assert {(r.kept, r.removed, r.shapley) for r in filter_interactions(one, labels).collect()} == {(1, 0, 0)}


def test_sketch_misses_no_repeat_and_clears_most_unique_texts(spark):
    rng = np.random.default_rng(1)
    single, double = rng.integers(-(2**62), 2**62, 4000), rng.integers(-(2**62), 2**62, 500)
    rows = [*single.tolist(), *double.tolist(), *double.tolist(), *[5] * 2000]
    sketch = duplicate_sketch(spark.createDataFrame([(h,) for h in rows], "h long").repartition(5), sketch_size(len(rows), 1 << 28))
    assert may_repeat(np.append(double, 5), sketch).all()
    assert may_repeat(single, sketch).mean() < 0.02


def test_a_full_sketch_changes_no_result(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2500).cast("string").alias("text"))
    for most in (1 << 18, 8):
        firsts, possible = first_copies(docs, "doc_id", "text", most)
        assert docs.where(possible & (F.col("doc_id") >= 2500)).count() == 500
        found = {r.first_id for r in firsts.collect()}
        assert set(range(500)) <= found and not any(f >= 2500 for f in found)
