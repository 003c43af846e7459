import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsieve.functions import lexicons as L
from quillsieve.functions import text as T
from quillsieve.operators import curation, dedup, evaluate, export, outcomes, playlists
from quillsieve.operators.punctuation import project, restore_punctuation, rule_completer, word_chunks
from quillsieve.sources import tables
from quillsieve.sources.config import CurationConfig
from quillsieve.streaming import state

# duplicates


def groups(spark, texts, **options):
    docs = spark.createDataFrame(list(texts.items()), "id string, text string")
    return {r.id: r for r in dedup.duplicate_groups(docs, "id", "text", options=dedup.DedupOptions(**options)).collect()}


def test_exact_and_near_groups(spark):
    base = "the quick brown fox jumps over the lazy dog near the old river bank today"
    got = groups(spark, {"a": base, "b": base.upper() + "!", "c": base + " again", "d": "something else entirely here now", "e": "!!", "f": None})
    assert {k: r.kind for k, r in got.items()} == {"a": "near", "b": "near", "c": "canonical", "d": "unique"}
    assert got["a"].canonical_id == "c" and got["a"].group_size == 3
    got = groups(spark, {"a": "same text", "b": "Same, text", "c": "other"})
    assert {k: r.kind for k, r in got.items()} == {"a": "near" if got["b"].canonical_id == "a" else "exact", "b": "canonical", "c": "unique"}


def test_prefixes_lose_no_link(spark):
    rng = random.Random(4)
    base = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 30))] for _ in range(12)]
    texts = {}
    for k in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice("abcxyz")
        texts[f"{k:03}"] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "key string, text string").select("key", F.lit("").alias("scope"), F.split("text", " ").alias("words"))
    grams = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or set(w) for k, w in ((k, t.split()) for k, t in texts.items())}
    for threshold, method in ((0.5, "exact"), (0.8, "exact"), (1.0, "exact"), (0.8, "minhash")):
        links = {(r.src, r.dst) for r in dedup.near_links(docs, dedup.DedupOptions(threshold=threshold, method=method)).collect()}
        want = {(a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) >= threshold * len(grams[a] | grams[b]) - 1e-9}
        assert links <= want and roots(links) == roots(want)


def roots(links):
    """The least member that each linked key reaches."""
    root = {k: k for link in links for k in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(root[a], root[b])
            changed |= root[a] != least or root[b] != least
            root[a] = root[b] = least
    return root


def test_a_large_group_costs_few_links(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    docs = [(f"{k:04}", "", [*base[:55], *(rng.choice(base) for _ in range(2))]) for k in range(400)]
    links = dedup.near_links(spark.createDataFrame(docs, "key string, scope string, words array<string>"), dedup.DedupOptions(threshold=0.8)).collect()
    assert len({k for r in links for k in r}) == 400 and len(links) < 4 * 400


def test_minhash_recall_at_the_threshold(spark):
    rng = random.Random(6)
    docs = []
    for k in range(150):  # pairs of 3-gram similarity just over 0.8
        w = [f"{k}x{i}" for i in range(60)]
        docs += [(f"{k}a", "", w), (f"{k}b", "", w[:30] + [f"{k}y"] + w[31:] + [rng.choice("ab")] * 2)]
    got = dedup.near_links(spark.createDataFrame(docs, "key string, scope string, words array<string>"), dedup.DedupOptions(threshold=0.8, method="minhash")).count()
    assert got >= 0.9 * 150


def plain_rank(values):
    return {v: (2 * sum(x < v for x in values) + values.count(v) + 1) / 2 for v in values}


def test_average_ranks_and_spearman(spark):
    rng = random.Random(7)
    rows = [(g, rng.randint(0, 9) / 2, rng.randint(0, 30)) for g in "ab" for _ in range(200)] + [("c", 1.0, 1), ("d", None, 2), (None, 1.0, 4), (None, 2.0, 5)]
    df = spark.createDataFrame(rows, "g string, x double, y int")
    got = {(r.g, r.x): r["rank"] for r in evaluate.average_ranks(df.where("x is not null"), ["g"], "x").collect()}
    for g in ("a", "b", "c", None):
        want = plain_rank([x for h, x, _ in rows if h == g and x is not None])
        assert {v: got[g, v] for v in want} == want
    rho = {r.g: r.rho for r in evaluate.spearman(df, ["g"], "x", "y").collect()}
    xs, ys = ([r[k] for r in rows if r[0] == "a"] for k in (1, 2))
    rx, ry = plain_rank(xs), plain_rank(ys)
    a, b = [rx[v] for v in xs], [ry[v] for v in ys]
    assert rho["a"] == pytest.approx(np.corrcoef(a, b)[0, 1]) and rho["c"] == 0 and "d" not in rho and rho[None] == pytest.approx(1)


def test_bootstrap_and_wilcoxon(spark):
    rng = random.Random(8)
    names = [n for n, _, _ in evaluate.METRICS]
    raw = [rng.gauss(0, 1) for _ in range(40)]
    rows = [(k, "auto" if k % 2 else "punctuated", *([r] * len(names)), *([r + 0.3 + rng.gauss(0, 0.5)] * len(names))) for k, r in enumerate(raw)]
    rows.append((99, "auto", *([None] * len(names)), *([1.0] * len(names))))
    schema = "id long, group string, " + ", ".join(f"raw_{n} double" for n in names) + ", " + ", ".join(f"processed_{n} double" for n in names)
    df = spark.createDataFrame(rows, schema)
    got = {(r.stratum, r.metric): r for r in evaluate.paired_intervals(df.repartition(3), "id").collect()}
    assert len(got) == 3 * len(names)
    delta = np.array([r[2 + len(names)] - r[2] for r in rows[:-1]])
    means = np.array([np.random.default_rng(k).choice(delta, len(delta)).mean() for k in range(4000)])
    r = got["all", "flesch"]
    assert r.ci_low == pytest.approx(np.percentile(means, 2.5), abs=0.03) and r.ci_high == pytest.approx(np.percentile(means, 97.5), abs=0.03)
    again = {(x.stratum, x.metric): x for x in evaluate.paired_intervals(df.repartition(5), "id").collect()}
    assert again["auto", "mtld"].ci_low == pytest.approx(got["auto", "mtld"].ci_low, abs=1e-12)  # the draw does not depend on where a row is
    few = [0.5, -0.2, 0.9, 1.4, -0.1, 0.7]
    ranks = plain_rank([abs(x) for x in few])
    up = sum(ranks[abs(x)] for x in few if x > 0)
    ways = [sum(k + 1 for k in range(6) if bits >> k & 1) for bits in range(64)]
    want = min(1, 2 * sum(w <= min(up, 21 - up) for w in ways) / 64)
    small = df.limit(6).toPandas()
    for n in names:
        small[f"raw_{n}"], small[f"processed_{n}"] = 0.0, few
    exact = {(x.stratum, x.metric): x.p for x in evaluate.paired_intervals(spark.createDataFrame(small, schema), "id").collect()}
    assert exact["all", "flesch"] == pytest.approx(want)


def test_scopes_and_assignments(spark):
    docs = spark.createDataFrame([(1, "x", "a b c d"), (2, "y", "a b c d"), (3, "x", "a b c d"), (4, "x", None)], "id long, scope string, text string")
    found = dedup.duplicate_groups(docs, "id", "text", ["scope"])
    got = {r.id: (r.deduplication_status, r.dedup_group_id) for r in dedup.assignments(docs, found, "id").collect()}
    assert got == {1: ("duplicate", "group-3"), 2: ("kept", "2"), 3: ("kept", "group-3"), 4: ("kept", "4")}
    assert tuple(dedup.dedup_stats(docs, found, "id").first()) == (4, 3, 1, 0, 2, 1)


def test_sentences_are_rebuilt(spark):
    docs = spark.createDataFrame([("d", "Alpha one two. Beta three four. Alpha one two."), ("e", ""), ("f", "One. Two.")], "id string, text string")
    got = {r.id: (r.deduplicated_text, r.removed) for r in dedup.dedup_sentences(docs, "id", "text").collect()}
    assert got == {"d": ("Beta three four. Alpha one two.", 1), "e": ("", 0), "f": ("One. Two.", 0)}


def test_options_are_checked():
    for bad in ({"threshold": 0}, {"ngram": 11}, {"method": "x"}):
        with pytest.raises(ValueError):
            dedup.DedupOptions(**bad)
    assert CurationConfig.of({}) == CurationConfig(0.8, 3, 1)
    with pytest.raises(ValueError):
        CurationConfig.of({"runs": "9"})


# exports

ROW = dict(
    id="1", title='say "hi"\nnext', youtubeId="v", playlistId=None, language="pt", content="  bruto  ", processedContent=None, qualityScore=0.5, mtldScore=12.0, mattrScore=None,
    llmCurationScore=0.7, coherence=7.0, richness=7.5, factuality=8.0, curationOverall=7.5, curationRationale="it's <ok> &\u0001", curationProvider="p", curationModel="m",
    curationChunkCount=1, deduplicationStatus="kept", dedupGroupId="1", status="COMPLETED",
)
KINDS = {k: "double" for k in ("qualityScore", "mtldScore", "mattrScore", "llmCurationScore", "coherence", "richness", "factuality", "curationOverall")} | {"curationChunkCount": "int"}


def admitted(spark, rows, stage="processed", duplicates=False):
    schema = ", ".join(f"{k} {KINDS.get(k, 'string')}" for k in ROW)
    df = spark.createDataFrame([tuple((ROW | r)[k] for k in ROW) for r in rows], schema)
    df = df.withColumn("text", export.export_text(stage, "content", "processedContent")).withColumn("dataset", F.lit(stage))
    kind = export.disposition(stage, duplicates, F.col("status"), F.col("deduplicationStatus"), F.col("coherence").isNotNull(), F.col("text"))
    return df.withColumn("disposition", kind)


def test_admission_order(spark):
    rows = [{"status": "ERROR", "deduplicationStatus": "duplicate"}, {"deduplicationStatus": "duplicate"}, {"content": " "}, {"coherence": None}, {}]
    assert tuple(export.export_counts(admitted(spark, rows)).first()) == (2, 1, 2)
    assert tuple(export.export_counts(admitted(spark, rows, "curated", True)).first()) == (2, 0, 2)
    assert admitted(spark, [{}], "raw").first().text == "bruto"


def test_formats(spark, tmp_path):
    df = admitted(spark, [{"content": "a\n>>>\nb"}])
    one = {f: export.serialize(df, f, ["id"]).first().record for f in export.MIME_TYPES}
    assert list(json.loads(one["json"])) == export.FIELDS and json.loads(one["json"])["mtldScore"] == 12 and '"mtldScore": 12,' in one["json"]
    assert one["csv"].startswith('1,"say ""hi""\nnext",v,,pt,processed,kept,1,0.5,12,,0.7')
    assert one["txt"].endswith("text<<<\na\n\\>>>\nb\n>>>\n<<<END>>>") and "title: say \"hi\" next" in one["txt"]
    assert 'title: "say \\"hi\\" next"' in one["md"] and "mattrScore: null" in one["md"]
    assert "<curationRationale>it&apos;s &lt;ok&gt; &amp;</curationRationale>" in one["xml"]
    assert export.envelope("txt", "raw", 0) == ("# dataset: raw\n# records: 0", "")
    with pytest.raises(ValueError):
        export.serialize(df, "pdf", ["id"])
    with pytest.raises(ValueError):
        export.check_scope("playlist")


# playlists and outcomes


def test_playlist_summary(spark):
    rows = spark.createDataFrame([("a", "COMPLETED", 5), ("a", "ERROR", 9), ("b", "ERROR", 1), ("c", "PROCESSING", 1), ("c", "COMPLETED", None)], "p string, status string, word_count int")
    got = {r.p: (r.status, r.error_message, r.total_word_count) for r in playlists.summarize(rows, "p").collect()}
    assert got == {"a": ("COMPLETED", "1" + L.FAILED_SUFFIX, 5), "b": ("ERROR", "1" + L.FAILED_SUFFIX, 0), "c": ("PROCESSING", None, 0)}


def test_cancel_and_resume(spark):
    rows = spark.createDataFrame([("p", k, "PROCESSING", None, k == 1) for k in range(4)] + [("q", 0, "PROCESSING", L.RATE_LIMITED, False), ("q", 1, "PROCESSING", None, False)], "p string, k int, status string, error_message string, rate_limited boolean")
    got = [(r.p, r.k, r.status) for r in playlists.cancel_after_rate_limit(rows, "p", "k").orderBy("p", "k").collect()]
    assert [s for _, _, s in got] == ["PROCESSING", "PROCESSING", "ERROR", "ERROR", "PROCESSING", "PROCESSING"]
    plan = {(r.p, r.k): (r.action, r.message) for r in playlists.resume_plan(rows, "p").collect()}
    assert plan[("q", 0)] == ("cancel", L.RATE_LIMITED) and plan[("q", 1)] == ("cancel", L.CANCELLED) and plan[("p", 0)] == ("resume", None)


def test_outcome_asymmetry(spark):
    row = spark.createDataFrame([(True, "  ", 0, None, None, None)], "s boolean, t string, n int, l string, k string, e string")
    c = [F.col(x) for x in "stnlke"]
    single, listed = row.select(outcomes.single_outcome(*c).alias("a"), outcomes.playlist_outcome(*c).alias("b")).first()
    assert single.status == "ERROR" and single.language == "en" and listed.kind == "completed" and listed.word_count == 0


def test_timeouts_and_resets(spark):
    got = spark.createDataFrame([(0, 1), (6001, 1), (120_000, 1)], "n int, r int").select(outcomes.curation_timeout_ms(F.col("n"), F.col("r")).alias("t")).collect()
    assert [r.t for r in got] == [210_000, 300_000, 900_000]
    rows = spark.createDataFrame([(1, "kept", "g", 0.5)], "id int, deduplication_status string, dedup_group_id string, curation_score double")
    assert tuple(playlists.reset_downstream(rows).first()) == (1, "pending", None, None)


# judge scores


def test_chunks(spark):
    texts = ["", "short text.", "One two. Three four. Five.", "x" * 25 + ". " + "yy. zz."]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.c for r in df.orderBy("k").select(curation.split_chunks("t", 12).alias("c")).collect()]
    assert got == [[], ["short text."], ["One two.", "Three four.", "Five."], ["x" * 12, "x" * 12, "x.", "yy. zz."]]
    many = spark.range(1).select(curation.select_chunks(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda x: x.cast("string"))).alias("c")).first().c
    assert len(many) == 10 and many[0] == "0" and many[-1] == "24"


def test_parse_reply(spark):
    raw = ['{"coherence": 8, "richness": "7.5", "factuality": 12, "rationale": "ok"}', '{"coherence": 8, "richness": 7}', '{"coherence": "high", "richness": 7, "factuality": 1}', "no",
           '{"coherence": 1, "richness": 2, "factuality": 3, "rationale": {"richness": "r ", "coherence": "c"}}']
    got = [r.p for r in spark.createDataFrame([(k, t) for k, t in enumerate(raw)], "k int, t string").orderBy("k").select(curation.parse_reply("t").alias("p")).collect()]
    assert (got[0].coherence, got[0].richness, got[0].factuality, got[0].overall, got[0].rationale) == (8, 7.5, 10, 8.5, "ok")
    assert got[1:4] == [None] * 3 and got[4].rationale == "c r" and got[4].criteria_rationale == {"coherence": "c", "richness": "r"}


def test_runs_and_failures(spark):
    class Flaky:
        provider, model = "first", "m1"

        def __call__(self, prompt, run):
            if run == 1:
                raise RuntimeError("down")
            return json.dumps({"coherence": 8 if run == 2 else 6, "richness": 5, "factuality": 5, "rationale": f"r{run}"})

    docs = spark.createDataFrame([(1, "Some text here."), (2, " ")], "id int, text string")
    (r,) = curation.curate(docs, "id", "text", [Flaky()], runs=3).collect()
    assert (r.id, r.coherence, r.coherence_std, r.runs, r.rationale, r.provider) == (1, 7.0, 1.0, 2, "r2", "first")
    (r,) = curation.curate(docs, "id", "text", [Flaky(), curation.HashJudge()], runs=1).collect()
    assert r.provider == "stub"


def test_pairwise_needs_both_orders(spark):
    rows = spark.createDataFrame([(1, "short", "a longer text"), (2, "same", "same")], "id int, raw string, processed string")
    longer = lambda a, b: "A" if len(a) > len(b) else "B" if len(b) > len(a) else "none"
    assert {r.id: (r.outcome, r.position_consistent) for r in curation.pairwise(rows, longer).collect()} == {1: ("processed", True), 2: ("tie", True)}


# punctuation


def test_projection():
    source = "amanhã cedo partimos para o farol com três lanternas"
    assert project(source, "Amanhã cedo partimos; para o farol, com três lanternas!") == "Amanhã cedo partimos; para o farol, com três lanternas!"
    hostile = project(source, "Ontem, cedo: nós partimos rumo ao farol. Com quatro lanternas, sim?")
    assert [w.strip(".,!?;:").lower() for w in hostile.split()] == source.split()
    assert project("we left early", "We left, as planned, early. Indeed!") == "We left, early."
    assert project("(done) 12 ok,", "Done. 12 OK") == "(done). 12 OK"
    assert project("", "x.") == ""


def test_restoration_is_gated_and_tolerates_failures(spark):
    rows = spark.createDataFrame([("word " * 30,), ("Short. Text.",), (None,)], "t string")
    got = restore_punctuation(rows, rule_completer, "t").collect()
    assert [r.punctuation_restored for r in got[:2]] == [True, False] and got[0].t.count(".") == 3 and got[2].t is None

    def fails(_):
        raise RuntimeError("down")

    assert not restore_punctuation(rows, fails, "t").first().punctuation_restored
    assert [len(c.split()) for c in rows.limit(1).select(word_chunks("t", 13).alias("c")).first().c] == [13, 13, 4]


# statistics


def test_kappa_and_spearman(spark):
    pairs = lambda a, b: evaluate.kappa(spark.createDataFrame(list(zip(a, b, strict=True)), "a string, b string")).first()
    assert pairs("xxyy", "xyyy").kappa == 0.5 and pairs("xx", "xx").kappa == 1.0 and pairs("xx", "yy").kappa == 0.0
    assert tuple(evaluate.kappa(spark.createDataFrame([], "a string, b string")).first()) == (0, 0.0, 0.0)
    rows = spark.createDataFrame([("p", float(k), 2.0 * k) for k in range(5)] + [("i", float(k), -1.0 * k) for k in range(5)] + [("c", float(k), 1.0) for k in range(5)], "g string, x double, y double")
    got = {r.g: r.rho for r in evaluate.spearman(rows, ["g"], "x", "y").collect()}
    assert got["p"] == pytest.approx(1) and got["i"] == pytest.approx(-1) and got["c"] == 0


def test_sign_test_and_report(spark):
    rows = [("a", "processed", True)] * 8 + [("a", "raw", False)] * 2 + [("b", "tie", True)]
    got = {r.grp: r for r in evaluate.judge_table(spark.createDataFrame(rows, "group string, outcome string, position_consistent boolean")).collect()}
    assert got["a"].p == pytest.approx(0.109375) and got["b"].p == 1.0 and (got["all"].n, got["all"].ties) == (11, 1)


def test_retention(spark):
    rows = spark.createDataFrame([(1, "Um um livro né", "um livro", "pt"), (2, "", "x", "en")], "id int, raw string, done string, lang string")
    assert {r.id: r.retention for r in evaluate.content_retention(rows, "id", "raw", "done", "lang").collect()} == {1: pytest.approx(2 / 3), 2: 1.0}


# sources and streams


def fetch(playlist, token):
    page = int(token or 0)
    return [{"video_id": f"{playlist}{page}", "title": "t"}, {"video_id": None, "title": "gone"}], str(page + 1) if page < 2 else None


def test_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "lang": "pt", "text": "olá"}, {"id": "2"}]))
    assert [tuple(r) for r in tables.read_corpus(spark, f"{tmp_path}/c.json").collect()] == [("1", "pt", "olá"), ("2", None, None)]
    tables.write_csv(spark.createDataFrame([("1", 'a "b",\nc')], "id string, outcome string").coalesce(1), f"{tmp_path}/l")
    assert [tuple(r) for r in tables.read_labels(spark, f"{tmp_path}/l").collect()] == [("1", 'a "b",\nc')]
    (tmp_path / "p.txt").write_text('{"a": 1}\n\n[1]\n{bad\n')
    got = [(r.payload.a if r.payload else None, r.rejected) for r in tables.read_payloads(spark, f"{tmp_path}/p.txt", "a int").collect()]
    assert got == [(1, None), (None, "empty"), (None, "not an object"), (None, "invalid")]


def test_playlist_source(spark):
    spark.dataSource.register(tables.PlaylistSource)
    spark.sparkContext.addPyFile(__file__)
    pages = spark.read.format("playlist_pages").option("playlists", "a,b").option("fetch", "test_operators:fetch").load()
    got = [(r.playlist_id, r.video_index, r.video_id) for r in tables.playlist_items(pages).orderBy("playlist_id", "video_index").collect()]
    assert got == [(p, k + 1, f"{p}{k}") for p in "ab" for k in range(3)]


def test_streams_resume_and_expire(spark, tmp_path):
    events = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("b", "2024-01-01 00:30:00", 2.0)], "token string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/in")
    seen = []
    stream = lambda: spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        state.run_available(stream(), lambda df, _: seen.extend(r.token for r in df.collect()), f"{tmp_path}/cp").awaitTermination()
    assert sorted(seen) == ["a", "b"]
    counts = []
    counted = state.activity_counts(stream(), key="token")
    state.run_available(counted, lambda df, _: counts.extend((r.token, r.n) for r in df.collect()), f"{tmp_path}/cp2", "complete").awaitTermination()
    assert sorted(counts) == [("a", 1), ("b", 1)]
    rows = events.select("token", F.lit("u").alias("user_id"), F.col("ts").alias("blacklisted_at"), F.col("ts").alias("expires_at"), F.lit("x").alias("reason"))
    now = F.lit("2024-01-01 00:30:00").cast("timestamp")
    assert [r.token for r in state.active_tokens(rows, now).collect()] == ["b"]
    assert tuple(state.blacklist_stats(rows, now).first()) == (2, 1, 1)
    once = state.tokens_stream(stream().withColumnRenamed("ts", "blacklisted_at"))
    state.run_available(once, lambda df, _: df.count(), f"{tmp_path}/cp3").awaitTermination()


def test_ngrams_cut_a_text_once(spark):
    rows = spark.createDataFrame([("a b c d",), ("a b",), ("",), (None,)], "text string")
    found = rows.select(dedup.ngrams(T.lower_words("text")).alias("g"))
    assert [r.g for r in found.collect()] == [["a b c", "b c d"], ["a", "b"], [], None]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
