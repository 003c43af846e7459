import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillsieve.llm import queries
from quillsieve.llm.graph import connected_components
from quillsieve.llm.repeats import remove_repeats, whole_characters
from quillsieve.llm.simhash import fingerprint_links, keep_one_per_component, simhash_components, trie_components

WORDS = ["alpha", "beta", "gamma", "délta", "eps", "x", "the", "of", "\n", "日本"]
SCHEMA = "doc_id long, text string, fp string, id string, kept string, spans int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 4 else [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def plain_repeats(docs, size):
    """docs: (id or None, bytes); the removed places of each, by the contract."""
    low = -(2**63)
    first = {}
    for i, b in docs:
        for s in range(len(b) - size + 1):
            at = (low if i is None else i, s)
            first[b[s : s + size]] = min(first.get(b[s : s + size], at), at)
    out = []
    for i, b in docs:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - size + 1):
            if first[b[s : s + size]] < (low if i is None else i, s):
                gone[s : s + size] = True
        out.append(gone)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    shared = [prose(rng, 40) for _ in range(4)]
    docs = []
    for i in range(90):
        kind = i % 9
        text = {
            0: lambda: prose(rng, 60),
            1: lambda: prose(rng, 10) + rng.choice(shared) + prose(rng, 20),
            2: lambda: rng.choice(docs)[1] or "",
            3: lambda: rng.choice(shared)[: rng.randint(90, 160)],
            4: lambda: "ab" * rng.randint(30, 300),
            5: lambda: (rng.choice(docs)[1] or "").replace("alpha", "omega", 1),
            6: lambda: rng.choice(shared)[rng.randint(0, 40) :] + rng.choice(shared),
            7: lambda: "  \n\t",
            8: lambda: None,
        }[kind]()
        docs.append((i, text))
    docs += [(5, docs[5][1]), (0, docs[0][1]), (1, docs[10][1]), (None, docs[0][1]), (None, None), (200, prose(rng, 9000))]
    return [(i, t, "a", "b", "c", 1) for i, t in docs]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_simhash_equals_brute_force(docs, rows):
    prints = [plain_fingerprint(r[1]) for r in rows]
    roots = plain_components(prints)
    least = {}
    for r, k in zip(rows, roots, strict=True):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    want = sorted(((r[0], f"{p:016x}", least.get(k)) for r, p, k in zip(rows, prints, roots, strict=True)), key=str)
    got = sorted((tuple(r) for r in simhash_components(docs).collect()), key=str)
    assert got == want


def test_keep_one_per_component(docs):
    kept = keep_one_per_component(docs)
    assert kept.columns == docs.columns
    lead = {r.doc_id for r in simhash_components(docs).collect() if r.doc_id == r.component_id}
    assert {r.doc_id for r in kept.collect()} - {None} == lead


def test_trie_components_equal_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3).astype(np.uint64)) for _ in range(600)])
    v = np.unique(np.concatenate((base, base[rng.integers(0, 40, 600)] ^ flips)))
    n = len(v)
    got = trie_components(v, np.array([[0], [n], [0], [n], [0]]), 4, leaf=16)
    want = plain_components([int(x) for x in v])
    assert [list(got).index(x) for x in got] == [want.index(x) for x in want]


def test_crowded_trie_nodes_are_split(spark):
    rng = np.random.default_rng(2)
    near = np.uint64(0xFFF0_0000_0000_0000) ^ (np.uint64(1) << rng.integers(0, 48, 900).astype(np.uint64)) ^ (
        np.uint64(1) << rng.integers(0, 48, 900).astype(np.uint64)
    ) ^ rng.integers(0, 4, 900).astype(np.uint64)
    far = rng.integers(0, 2**63, 300, dtype=np.uint64)
    v = np.unique(np.concatenate((near, far)))
    fps = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    whole = {tuple(r) for r in connected_components(fingerprint_links(fps)).collect()}
    split = {tuple(r) for r in connected_components(fingerprint_links(fps, node_rows=32)).collect()}
    assert split == whole and whole


def test_connected_components_of_a_chain_and_nothing(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7), (None, 3), (100, 101)], "src long, dst long")
    got = {r.node: r.root for r in connected_components(chain).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
    assert connected_components(chain.limit(0)).count() == 0


@pytest.mark.parametrize("size, digit, crowd", [(100, 32, 50_000), (60, 20, 50_000), (100, 32, 3)])
def test_repeats_equal_brute_force(docs, rows, size, digit, crowd):
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    want = []
    for (i, b), gone in zip(raw, plain_repeats(raw, size), strict=True):
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want.append((i, int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    got = remove_repeats(docs, threshold=size, digit=digit, crowd=crowd).select("doc_id", removed, F.size("spans"), F.sha2("kept", 256))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert any(w[1] for w in want)


def test_repeats_without_repeated_ids_and_empty(spark, rows):
    unique = list({r[0]: r for r in rows if r[0] is not None}.values())
    raw = [(r[0], (r[1] or "").encode()) for r in unique]
    docs = spark.createDataFrame(unique, SCHEMA).repartition(7)
    got = {r.doc_id: sum(s.end - s.start for s in r.spans) for r in remove_repeats(docs).collect()}
    assert got == {i: int(g.sum()) for (i, _), g in zip(raw, plain_repeats(raw, 100), strict=True)}
    assert remove_repeats(docs.limit(0)).count() == 0
    assert simhash_components(docs.limit(0)).count() == 0


def test_registered_queries_have_a_row_for_each_document(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert queries.op1_simhash_near_dedup(spark, sf_dir).count() == n
    found = queries.op6_suffix_array_dedup(spark, sf_dir)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and found.count() == n


def test_whole_characters_drops_characters_cut_in_part():
    raw = "aé€\ufffdb€z".encode()
    for a in range(len(raw)):
        for b in range(a + 1, len(raw) + 1):
            assert whole_characters([raw[:a], raw[b:]]) == raw[:a].decode("utf-8", "ignore") + raw[b:].decode("utf-8", "ignore")
    assert whole_characters([raw]) == raw.decode() and whole_characters([b"", b""]) == ""
    assert "\ufffd" in whole_characters([raw[:2], raw[5:6], raw[6:]])


def test_kept_text_is_the_decoded_rest(spark):
    same = "é" * 120
    docs = spark.createDataFrame([(1, same + "a"), (2, "b€" + same), (3, None), (4, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.kept_text, len(r.spans)) for r in remove_repeats(docs, decode=True).collect()}
    assert got == {1: ("éa", 1), 2: ("b€", 1), 3: (None, 0), 4: (None, 0)}

