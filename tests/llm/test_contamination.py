import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from quillsieve.llm.contamination import ItemIndex, Walks, cut_item, edited, find_leaks, gram_size, least_edits, normalised, walks_for

TEXT = "The quick brown fox jumps over the lazy dog while a small bird sings near an old mill and nobody listens to it at all today."


def plain_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for k, p in enumerate(pattern, 1):
            new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


def test_least_edits_equals_the_plain_table():
    rng = random.Random(9)
    for _ in range(150):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 70)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        assert least_edits(a, b, len(a))[0] == plain_distance(a, b)


@pytest.fixture(scope="module")
def benchmark(spark, sf_dir):
    items = {r.item_id: normalised(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    others = [normalised(r.text)[:900] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    short = {1000 + k: normalised(" ".join(others[k].split()[:n])) for k, n in enumerate((3, 4, 5, 6, 8, 10))}  # items of a few words
    return items, short, [t for t in others if len(t) > 100]


@pytest.mark.parametrize("kind", ["even", "random", "block"])
@pytest.mark.parametrize("share", [0.03, 0.06, 0.09, 0.1])
def test_recall_up_to_the_limit(benchmark, kind, share):
    """At least 0.95 of the copies with so many edits are found, short items included; nothing beyond the distance is."""
    items, short, others = benchmark
    every = items | short
    index = ItemIndex(list(every), list(every.values()), walks=walks_for(list(every.values()), 0.1, 0.99, 0.2))
    rng = random.Random(f"{kind}{share}")
    found = total = 0
    for i, t in every.items():
        copy = edited(t.strip(), int(share * len(t)), kind, rng)
        doc = normalised(f"{rng.choice(others)} {copy} {rng.choice(others)}")
        got = index.leaks([doc])[0]
        found += any(x["item_id"] == i for x in got)
        total += 1
        for x in got:
            assert plain_distance(every[x["item_id"]], doc) == x["distance"] <= int(0.1 * len(every[x["item_id"]]))
    assert found >= 0.95 * total


def test_no_region_is_lost():
    """The q-gram lemma: every place of a match within the budget lies in a region, whatever the edits."""
    rng = random.Random(11)
    for _ in range(300):
        item = normalised("".join(rng.choice("abcd ") for _ in range(rng.randint(2, 60))))
        if not item:
            continue
        index = ItemIndex([1], [item])
        budget = int(0.1 * len(item))
        copy = edited(item, budget, rng.choice(["even", "random", "block"]), rng)
        before = "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 30)))
        assert any(a <= len(before) <= b for _, _, a, b in index.regions([before + copy + "zz"]))


def test_templates_of_many_items():
    """Runs that very many items share are left out where an item has others, and no item is missed for it."""
    rng = random.Random(12)
    head = "answer the following question about the history of the town and give reasons "
    items = [normalised(head + "".join(rng.choice("abcdefghij ") for _ in range(150))) for _ in range(80)]
    index = ItemIndex(list(range(80)), items)
    assert sum(len(h) for h, *_ in index.runs.values()) < 80 * (len(items[0]) - 7 - 15)
    for k in range(0, 80, 7):
        budget = int(0.1 * len(items[k]))
        doc = normalised("xx " + edited(items[k].strip(), budget, "random", rng) + " yy")
        assert (k in [x["item_id"] for x in index.leaks([doc])[0]]) == (plain_distance(items[k], doc) <= budget)  # white space that edits leave may cost more


@pytest.mark.parametrize("most", [1, 7, 1 << 19])
def test_hits_by_diagonal_equal_a_plain_count(most):
    """Counts of (text, item, diagonal), whatever the size of the pieces."""
    rng = random.Random(13)
    index = ItemIndex([1, 2], ["ha ha ha", "ah ah"])
    item_of, offset_of = np.array([0, 0, 1, 0, 1]), np.array([0, 3, 0, 6, 2])
    runs = [(0, 3), (3, 1), (4, 1), (1, 4)]
    for _ in range(20):
        places = sorted((rng.randrange(3), rng.randrange(50), rng.choice(runs)) for _ in range(rng.randint(1, 40)))
        doc, at = (np.array([p[k] for p in places]) for k in (0, 1))
        lo, n = (np.array([p[2][k] for p in places]) for k in (0, 1))
        want = Counter((d * 2 + int(item_of[j])) * 100 + a - int(offset_of[j]) + index.longest for d, a, (f, m) in places for j in range(f, f + m))
        keys, hits = index._diagonals(at, doc, lo, n, item_of, offset_of, 100, most)
        assert dict(zip(keys.tolist(), hits.tolist(), strict=True)) == want and keys.tolist() == sorted(want)


def test_chants_take_bounded_memory():
    """40 million pairs of equal runs; the memory follows the diagonals."""
    index = ItemIndex([1, 2], [normalised("ha " * 660), normalised("la la " * 10 + TEXT)])
    tracemalloc.start()
    got = index.leaks([normalised("ha " * 20_000 + TEXT), normalised("hu " * 2000)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [[(x["item_id"], x["distance"]) for x in g] for g in got] == [[(1, 0)], []]
    assert peak < 200_000_000


def test_a_target_beyond_the_walks_is_reported():
    with pytest.warns(UserWarning, match="less than the target"):
        assert walks_for([TEXT * 3], 0.9, 1.0, 2.0) == 32


def test_keys_do_not_depend_on_the_other_windows():
    own = Walks(4)
    windows = [("abcdefgh ijk" * 5, 40), ("x", 7), (TEXT, 90)]
    together = own.keys_of(windows)
    assert all((own.keys_of([w])[0] == together[k]).all() for k, w in enumerate(windows))
    assert gram_size(81, 8) == 8 and gram_size(12, 1) == 6 and gram_size(3, 0) == 3
    assert "".join(p.strip() for p in cut_item("ab cd " * 50, 40)).replace(" ", "") == "abcd" * 50


def test_leaks_on_hard_rows(spark):
    long_ = "filler words go on " * 20_000
    docs = spark.createDataFrame(
        [(1, None, "l"), (2, "", "l"), (3, f"before {TEXT.upper()}  after", "l"), (3, f"before {TEXT}", "l"), (4, "it is forty two now", "l"), (5, long_ + TEXT + long_, "l"), (None, "x" * 300_000, "l")],
        "doc_id long, text string, leaks string",
    )
    items = spark.createDataFrame([("9", TEXT, 1), ("9", TEXT, 1), ("8", "forty  two", 1), ("7", None, 1), ("6", " ", 1), (None, TEXT, 1), ("5", TEXT * 40, 1)], "item_id string, text string, leaks int")
    for chars in (4_000_000, 50):  # one block of items, and several
        got = sorted((r.doc_id or 0, [x.item_id for x in r.leaks]) for r in find_leaks(docs, items, block_chars=chars).collect())
        assert got == [(0, []), (1, []), (2, []), (3, ["9"]), (3, ["9"]), (4, ["8"]), (5, ["9"])]
    assert find_leaks(docs, items.limit(0)).count() == 7
    assert find_leaks(docs.limit(0), items).count() == 0
    assert ItemIndex([], []).leaks(["a", ""]) == [[], []]
