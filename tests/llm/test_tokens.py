import hashlib
import math
import random

import pytest
import sentencepiece

from quillsieve.llm import queries
from quillsieve.llm.pieces import PieceTable, encode_pieces
from quillsieve.llm.unigram import UnigramCounter, fit_scores, rank_scores, token_counts, vocabulary

MODEL = queries.piece_model()
HARD = ["", None, " ", "  lead  and trail ", "a\n\nb\t c", "▁a ▁▁", "é日本😀", "\x00\x01", "x" * 5000, " " * 40, "ﬁ Å ①", "=" * 70, "word " * 3000]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_equal_the_library_on_random_texts(model):
    rng, table = random.Random(1), PieceTable(MODEL, most=200)
    parts = [*" ab e\té\n▁", "  ", "the", "ing", "日本", "😀", "http://", "==", " " * 17, "\x00"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        ids = memoryview(table.encode_text(text)).cast("i").tolist()
        assert ids == model.encode(text)
        assert table.decode(ids) == model.decode(ids)


def test_decode_of_any_ids_equals_the_library(model):
    rng, table = random.Random(2), PieceTable(MODEL)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 12))]
        assert table.decode(ids) == model.decode(ids)


def test_encode_pieces_on_hard_rows(spark, model):
    docs = spark.createDataFrame([(k, t, "old") for k, t in enumerate(HARD + HARD[:3])], "doc_id long, text string, ids string")
    got = encode_pieces(docs.repartition(3), MODEL)
    assert got.columns == ["doc_id", "ids", "decoded"]
    texts = HARD + HARD[:3]
    for r in got.collect():
        ids = model.encode(texts[r.doc_id] or "")
        assert (r.ids, r.decoded) == (ids, model.decode(ids))
    assert encode_pieces(docs.limit(0), MODEL).count() == 0


def test_op7_digests(spark, sf_dir, model):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op7_sentencepiece(spark, sf_dir).collect():
        ids = model.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def plain_count(scores, word):
    """Best segmentation by trying every cut of every prefix, with no sharing."""
    text, unknown = "▁" + word, min(scores.values()) - 10
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        options = []
        for start in range(end):
            if text[start:end] in scores:
                options.append((best[start][0] + scores[text[start:end]], best[start][1] + 1))
        if text[end - 1] not in scores:
            n = len(text[end - 1].encode())
            options.append((best[end - 1][0] + unknown * n, best[end - 1][1] + n))
        best.append(max(options, key=lambda x: (x[0], -x[1])))
    return best[-1][1]


def test_unigram_counts_equal_plain_viterbi():
    rng = random.Random(4)
    scores = {p: -math.log(k + 2) for k, p in enumerate(["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba", "bb", "▁ba"])}
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    counter = UnigramCounter(scores, most=50)
    for start in range(0, 400, 40):
        texts = [" ".join(words[start + k : start + k + 10]) for k in range(0, 40, 10)]
        want = [(len(t.split()), sum(plain_count(scores, w) for w in t.split())) for t in texts]
        assert counter.count(texts) == want


def test_token_counts_on_hard_rows(spark):
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(HARD)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in token_counts(docs, rank_scores(vocabulary(MODEL))).collect()}
    counter = UnigramCounter(rank_scores(vocabulary(MODEL)))
    for k, t in enumerate(HARD):
        words = (t or "").split()
        assert got[k] == (len(words), sum(plain_count(counter.scores, w) for w in words if len(w) < 100) or got[k][1])
    assert got[0] == got[1] == got[2] == (0, 0)
    assert token_counts(docs.limit(0), {"a": -1.0}).count() == 0


def test_op10_has_a_row_for_each_document(spark, sf_dir):
    assert queries.op10_token_counts(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_fitted_scores_equal_a_plain_fit_and_raise_the_likelihood(spark):
    rng = random.Random(5)
    pieces = ("▁", "a", "b", "ab", "ba", "▁ab", "aba", "bb", "▁ba", "▁a")
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(50)) for _ in range(20)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, "", " \n"])], "doc_id long, text string").repartition(3)
    scores, likelihood = fit_scores(docs, pieces, rounds=3)
    plain, seen = rank_scores(pieces), []
    for _ in range(3):
        counter, counts, total, places = UnigramCounter(plain), {p: 1 for p in pieces}, 0.0, 0
        for word in " ".join(texts).split():
            (own,) = counter.segments([word])
            total, places = total + sum(plain.get(p, 0.0) for p in own), places + 1
            for p in own:
                if p in counts:
                    counts[p] += 1
        seen.append(total / places)
        plain = {p: math.log(n / sum(counts.values())) for p, n in counts.items()}
    assert likelihood == pytest.approx(seen) and scores == pytest.approx(plain)
    assert likelihood[0] < likelihood[1] <= likelihood[2] + 1e-9
    assert math.fsum(map(math.exp, scores.values())) == pytest.approx(1)
    assert fit_scores(docs.limit(0), pieces) == (rank_scores(pieces), [])
