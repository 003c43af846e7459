"""Duplicates, judge scores, judge reliability and streams over the tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillsieve.functions import lexicons as L
from quillsieve.functions import text as T
from quillsieve.operators import curation, dedup, evaluate
from quillsieve.plans.registry import Registry, documents, table
from quillsieve.plans.text_queries import _SPLIT_SQL, SPACE_SQL, WORDS_SQL, digest
from quillsieve.streaming import state

query = Registry()

_LOW = f"list_transform({WORDS_SQL}, lambda x: lower(x))"
_GRAMS = "list_distinct(case when len(w) < 3 then w else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end)"


def _groups_sql(scope: str) -> str:
    """Exact Jaccard over word 3-grams and the transitive closure of the links, as SQL states it."""
    return f"""
    with recursive r as (select doc_id, {scope} as scope, length(text) as n_chars, {_LOW} as w from documents),
    h as (select *, sha256(array_to_string(w, ' ')) as hash, {_GRAMS} as g from r where len(w) > 0),
    t as (select scope, hash, min(doc_id) as k, any_value(g) as g from h group by scope, hash),
    e as (select k, scope, len(g) as n, unnest(g) as x from t),
    c as (select a.k as a, b.k as b, a.n as na, b.n as nb, count(*) as c from e a join e b on a.scope = b.scope and a.x = b.x and a.k < b.k group by all),
    l as (select a, b from c where c >= 0.8 * (na + nb - c) - 1e-9),
    pairs as (select a, b from l union all select b, a from l),
    reach(k, root) as (select k, k from t union select pairs.b, reach.root from reach join pairs on reach.k = pairs.a),
    roots as (select k, min(root) as root from reach group by k),
    j as (select h.doc_id, h.scope, h.hash, h.n_chars, root from h join t using (scope, hash) join roots using (k)),
    m as (select root, arg_max(doc_id, (n_chars, doc_id::varchar)) as canonical_id, arg_max(hash, (n_chars, doc_id::varchar)) as canonical_hash, count(*) as group_size from j group by root),
    s as (select doc_id, scope, hash, canonical_id, group_size, case when group_size = 1 then 'unique' when doc_id = canonical_id then 'canonical' when hash = canonical_hash then 'exact' else 'near' end as kind from j join m using (root))
    """


@query(f"select hash, min(doc_id) as first_id, count(*)::bigint as n from (select doc_id, sha256(array_to_string({_LOW}, ' ')) as hash from documents) group by hash having count(*) > 1")
def d1_a10_exact_buckets(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", T.exact_hash("text").alias("hash"))
    return rows.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


@query(f"select doc_id, len(g)::bigint as n_grams, sha256(array_to_string(list_sort(g), chr(10))) as grams_sha from (select doc_id, {_GRAMS} as g from (select doc_id, {_LOW} as w from documents))")
def d2_ngrams(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", T.lower_words("text").alias("w"))
    rows = rows.select("doc_id", F.array_sort(F.array_distinct(dedup.ngrams("w"))).alias("g"))
    return rows.select("doc_id", F.size("g").cast("long").alias("n_grams"), digest(F.array_join("g", "\n")).alias("grams_sha"))


@query(_groups_sql("''") + "select doc_id, canonical_id, kind, group_size::bigint as group_size from s")
def d5_d6_d7_duplicate_groups(spark, sf_dir):
    return dedup.duplicate_groups(documents(spark, sf_dir), "doc_id", "text").drop("group_root")


@query(_groups_sql("source") + "select doc_id, case when kind in ('exact', 'near') then 'duplicate' else 'kept' end as deduplication_status, case when group_size > 1 then 'group-' || canonical_id else doc_id::varchar end as dedup_group_id from documents left join s using (doc_id)")
def d8_d10_j4_assignments_by_scope(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return dedup.assignments(docs, dedup.duplicate_groups(docs, "doc_id", "text", ["source"]), "doc_id")


@query(_groups_sql("''") + """select (select count(*) from documents)::bigint as input, count(*)::bigint as compared, count(*) filter (kind = 'exact')::bigint as exact, count(*) filter (kind = 'near')::bigint as near,
    count(*) filter (kind in ('canonical', 'unique'))::bigint as kept, count(*) filter (kind = 'canonical')::bigint as groups from s""")
def a9_dedup_stats(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return dedup.dedup_stats(docs, dedup.duplicate_groups(docs, "doc_id", "text"), "doc_id")


@query(_groups_sql("''") + "select doc_id, canonical_id, kind, group_size::bigint as group_size from s")
def d3_d4_minhash_groups(spark, sf_dir):
    return dedup.duplicate_groups(documents(spark, sf_dir), "doc_id", "text", options=dedup.DedupOptions(method="minhash")).drop("group_root")


@query(f"""
    with recursive s0 as (select doc_id, unnest(p) as sentence, generate_subscripts(p, 1) - 1 as idx from (select doc_id, {_SPLIT_SQL} as p from documents)),
    r as (select doc_id, idx, sentence, length(sentence) as n_chars, doc_id || ':' || lpad(idx::varchar, 6, '0') as sid, list_transform({WORDS_SQL.replace("(text,", "(sentence,")}, lambda x: lower(x)) as w from s0),
    h as (select *, array_to_string(w, ' ') as hash, {_GRAMS} as g from r where len(w) > 0),
    t as (select doc_id, hash, min(idx) as k, any_value(g) as g from h group by doc_id, hash),
    e as (select k, doc_id, len(g) as n, unnest(g) as x from t),
    c as (select a.doc_id, a.k as a, b.k as b, a.n as na, b.n as nb, count(*) as c from e a join e b on a.doc_id = b.doc_id and a.x = b.x and a.k < b.k group by all),
    l as (select doc_id, a, b from c where c >= 0.8 * (na + nb - c) - 1e-9),
    pairs as (select doc_id, a, b from l union all select doc_id, b, a from l),
    reach(doc_id, k, root) as (select doc_id, k, k from t union select reach.doc_id, pairs.b, reach.root from reach join pairs on reach.doc_id = pairs.doc_id and reach.k = pairs.a),
    roots as (select doc_id, k, min(root) as root from reach group by all),
    j as (select h.doc_id, h.idx, h.sid, h.n_chars, root from h join t using (doc_id, hash) join roots using (doc_id, k)),
    m as (select doc_id, root, arg_max(idx, (n_chars, sid)) as canonical from j group by all),
    gone as (select j.doc_id, j.idx from j join m using (doc_id, root) where j.idx <> m.canonical),
    kept as (select s0.doc_id, string_agg(sentence, ' ' order by s0.idx) filter (gone.idx is null) as text, count(gone.idx) as removed from s0 left join gone using (doc_id, idx) group by s0.doc_id)
    select doc_id, sha256(coalesce(kept.text, '')) as deduplicated_sha, coalesce(removed, 0)::bigint as removed from documents left join kept using (doc_id)
""")
def d9_j8_sentence_dedup(spark, sf_dir):
    found = dedup.dedup_sentences(documents(spark, sf_dir), "doc_id", "text")
    return found.select("doc_id", digest(F.col("deduplicated_text")).alias("deduplicated_sha"), "removed")


_HASHED = """
    with recursive s as (select item_id, length(text) as n from benchmark),
    runs as (select item_id, unnest([1, 2, 3]) as run, n from s),
    v as (select item_id, run, ((n + 7 * run) * 3) % 101 / 10.0::double as coherence, ((n + 7 * run) * 4) % 101 / 10.0::double as richness, ((n + 7 * run) * 5) % 101 / 10.0::double as factuality from runs)
"""


@query(_HASHED + """
    , m as (select item_id, round(avg(coherence), 2) as coherence, round(avg(richness), 2) as richness, round(avg(factuality), 2) as factuality, round(stddev_pop(coherence), 2) as coherence_std from v group by item_id)
    select item_id, coherence, richness, factuality, round((coherence + richness + factuality) / 3, 2) as overall, coherence_std, 3::bigint as runs, 'run 1' as rationale from m
""")
def a12_x6_run_aggregates(spark, sf_dir):
    class LengthJudge:
        provider, model = "stub", "length"

        def __call__(self, prompt: str, run: int) -> str:
            seed = int(prompt) + 7 * run
            return json.dumps({c: (seed * (k + 3)) % 101 / 10 for k, c in enumerate(L.CRITERIA)} | {"rationale": f"run {run}"})

    prompts = table(spark, sf_dir, "benchmark").select("item_id", F.lit(0).alias("chunk_idx"), F.length("text").cast("string").alias("prompt"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("run"))
    parsed = curation.ask(prompts, [LengthJudge()]).withColumn("p", curation.parse_reply("raw")).select("item_id", "chunk_idx", "run", "provider", "model", "p.*")
    got = curation.aggregate_runs(parsed.drop("overall"), ["item_id", "chunk_idx"])
    return got.select("item_id", "coherence", "richness", "factuality", "overall", "coherence_std", "runs", "rationale")


@query("""
    with v as (select l_orderkey, l_linenumber, (l_partkey % 101)::double as a, (l_suppkey % 101)::double as b, (l_quantity::double % 11) as c from (select distinct on (l_orderkey, l_linenumber) * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)),
    m as (select l_orderkey, round(avg(a), 2) as coherence, round(avg(b), 2) as richness, round(avg(c), 2) as factuality, count(*)::bigint as chunk_count, array_to_string((list('r' || l_linenumber order by l_linenumber) filter (l_linenumber % 2 = 1))[1:3], ' ') as rationale, arg_max('p' || l_linenumber, l_linenumber) as provider from v group by 1)
    select l_orderkey, coherence, richness, factuality, round((coherence + richness + factuality) / 3, 2) as overall, chunk_count, coalesce(rationale, '') as rationale, provider from m
""")
def a11_x7_chunk_aggregates(spark, sf_dir):
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("m"))
    chunks = one.select(
        "l_orderkey", F.col("l_linenumber").alias("chunk_idx"), (F.col("m.l_partkey") % 101).cast("double").alias("coherence"), (F.col("m.l_suppkey") % 101).cast("double").alias("richness"),
        (F.col("m.l_quantity").cast("double") % 11).alias("factuality"), *[F.lit(0.0).alias(f"{c}_std") for c in L.CRITERIA], F.lit(1).alias("runs"),
        F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("r"), "l_linenumber")).otherwise(" ").alias("rationale"), F.create_map().cast("map<string,string>").alias("criteria_rationale"),
        F.concat(F.lit("p"), "l_linenumber").alias("provider"), F.lit("m").alias("model"),
    )
    got = curation.aggregate_chunks(chunks, "l_orderkey")
    return got.select("l_orderkey", "coherence", "richness", "factuality", "overall", "chunk_count", "rationale", "provider")


@query(rf"""
    with t as (select doc_id, nullif(regexp_replace(text, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g'), '') as text from documents),
    s as (select doc_id, text, list_reduce(list_transform({_SPLIT_SQL}, lambda x: {{'done': []::varchar[], 'open': '', 's': x}}),
      lambda a, b: case when len(case when a.open = '' then b.s else a.open || ' ' || b.s end) <= 600 then {{'done': a.done, 'open': case when a.open = '' then b.s else a.open || ' ' || b.s end, 's': ''}}
        when len(b.s) > 600 then {{'done': list_concat(case when a.open = '' then a.done else list_append(a.done, a.open) end,
          list_filter(list_transform(range(0, len(b.s), 600), lambda k: trim(substring(b.s, k + 1, 600), ' ')), lambda x: x <> '')), 'open': '', 's': ''}}
        else {{'done': case when a.open = '' then a.done else list_append(a.done, a.open) end, 'open': b.s, 's': ''}} end,
      {{'done': []::varchar[], 'open': '', 's': ''}}) as f from t),
    c as (select doc_id, case when text is null then []::varchar[] when len(text) <= 600 then [text] when f.open = '' then f.done else list_append(f.done, f.open) end as c from s),
    k as (select doc_id, c, case when len(c) <= 10 then c else list_transform(range(0, 10), lambda i: c[round_even(i * (len(c) - 1) / 9.0::double, 0)::bigint + 1]) end as chosen from c)
    select doc_id, len(c)::int as chunks, len(chosen)::int as chosen, sha256(array_to_string(chosen, chr(10))) as chosen_sha from k
""")
def x1_x2_w6_chunks(spark, sf_dir):
    chunks = curation.split_chunks("text", 600)
    rows = documents(spark, sf_dir).select("doc_id", chunks.alias("c")).withColumn("chosen", curation.select_chunks("c"))
    return rows.select("doc_id", F.size("c").alias("chunks"), F.size("chosen").alias("chosen"), digest(F.array_join("chosen", "\n")).alias("chosen_sha"))


@query()
def x3_x11_curated_documents(spark, sf_dir):
    return curation.curate(documents(spark, sf_dir), "doc_id", "text", [curation.HashJudge()], runs=2).drop("model")


@query(rf"""
    with t as (select doc_id, list_filter(regexp_split_to_array(text, '{SPACE_SQL}+'), lambda w: w <> '') as a, list_filter(regexp_split_to_array(replace(replace(text, ' the ', ' '), ' de ', ' '), '{SPACE_SQL}+'), lambda w: w <> '') as b from documents),
    e as (select doc_id, length(array_to_string(a[1:180], ' ')) as raw, length(array_to_string(b[1:greatest(1, round_even(180 * len(b) / greatest(1, len(a)), 0))::bigint], ' ')) as processed from t)
    select doc_id, case when raw = processed then 'tie' when raw < processed then 'raw' else 'processed' end as outcome, raw <> processed as position_consistent from e
""")
def x8_pairwise_shorter_wins(spark, sf_dir):
    """A judge that prefers the shorter version, and the first of equal ones: then the order decides, and that is a tie."""
    rows = documents(spark, sf_dir).select("doc_id", F.col("text").alias("raw"), F.replace(F.replace("text", F.lit(" the "), F.lit(" ")), F.lit(" de "), F.lit(" ")).alias("processed"))
    return curation.pairwise(rows, lambda a, b: "Version A" if len(a) <= len(b) else "version_b", "doc_id")


_VERDICTS = "select l_orderkey, l_returnflag as grp, case when l_quantity > 30 then 'processed' when l_quantity > 20 then 'raw' else 'tie' end as outcome, l_discount::double < 0.05 as ok from lineitem"


@query(f"""
    with v as ({_VERDICTS}), r as (select 'all' as grp, outcome, ok from v union all select grp, outcome, ok from v)
    select grp, count(*)::bigint as n, count(*) filter (outcome = 'processed')::bigint as wins, count(*) filter (outcome = 'raw')::bigint as losses, count(*) filter (outcome = 'tie')::bigint as ties, round(avg(ok::int), 6) as consistency from r group by grp
""")
def a15_judge_table(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("group"), F.when(F.col("l_quantity") > 30, "processed").when(F.col("l_quantity") > 20, "raw").otherwise("tie").alias("outcome"), (F.col("l_discount").cast("double") < 0.05).alias("position_consistent")
    )
    return evaluate.judge_table(rows).drop("p").withColumn("consistency", F.round("consistency", 6))


_KAPPA = """
    n as (select count(*) as n, avg((a = b)::int) as agreement from p),
    e as (select sum(x.c::double * y.c) as s from (select a, count(*) as c from p group by a) x join (select b, count(*) as c from p group by b) y on x.a = y.b)
    select n::bigint as n, round(coalesce(agreement, 0), 6) as agreement, round((agreement - s / (n * n)) / (1 - s / (n * n)), 6) as kappa from n, e
"""


@query(f"with p as (select quality::varchar as a, (n_chars > 1000)::int::varchar as b from documents join labels using (doc_id)), {_KAPPA}")
def a17_a18_j5_se4_agreement(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") > 1000).cast("int").cast("string").alias("outcome"), F.lit(1).alias("at"))
    early = docs.withColumns({"outcome": F.lit("9"), "at": F.lit(0)})  # an earlier row of the same human, which the later one replaces
    judged = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("outcome"))
    return evaluate.agreement_with_humans(judged, docs.unionByName(early), "at").select("n", F.round("agreement", 6).alias("agreement"), F.round("kappa", 6).alias("kappa"))


@query("""
    with r as (select l_returnflag as g, l_quantity::double as x, l_extendedprice::double as y from lineitem),
    k as (select g, x, y, rank() over (partition by g order by x) + (count(*) over (partition by g, x) - 1) / 2.0 as rx, rank() over (partition by g order by y) + (count(*) over (partition by g, y) - 1) / 2.0 as ry from r)
    select g, round(corr(rx, ry), 6) as rho from k group by g
""")
def a19_spearman(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    return evaluate.spearman(rows, ["g"], "x", "y").select("g", F.round("rho", 6).alias("rho"))


@query("""
    with s as (select doc_id, unnest(['a', 'b', 'c']) as v, unnest([n_chars::double, length(source) * 1000.0 + n_chars % 97, n_chars % 1000 + 0.0]) as x from documents),
    p as (select a.v as va, b.v as vb, a.x as x, b.x as y from s a join s b using (doc_id) where a.v < b.v),
    k as (select va, vb, x, y, rank() over (partition by va, vb order by x) + (count(*) over (partition by va, vb, x) - 1) / 2.0 as rx, rank() over (partition by va, vb order by y) + (count(*) over (partition by va, vb, y) - 1) / 2.0 as ry from p),
    c as (select corr(rx, ry) as rho, avg(abs(x - y)) as d from k group by va, vb)
    select round(avg(rho), 6) as mean_spearman, round(max(d), 4) as max_mean_abs_diff from c
""")
def a20_x10_variant_stability(spark, sf_dir):
    n = F.col("n_chars")
    kinds = F.array(F.struct(F.lit("a").alias("variant"), n.cast("double").alias("score")), F.struct(F.lit("b").alias("variant"), (F.length("source") * 1000.0 + n % 97).cast("double").alias("score")), F.struct(F.lit("c").alias("variant"), (n % 1000).cast("double").alias("score")))
    scores = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.explode(kinds).alias("k")).select("doc", "k.*")
    return evaluate.variant_stability(scores).select(F.round("mean_spearman", 6).alias("mean_spearman"), F.round("max_mean_abs_diff", 4).alias("max_mean_abs_diff"))


_NOW = "timestamp '2024-01-20 00:00:00'"


@query(f"""with b as (select user_id::varchar as token, max(ts) + interval 5 days as expires_at from events group by 1)
    select count(*)::bigint as total, count(*) filter (expires_at >= {_NOW})::bigint as active, count(*) filter (expires_at < {_NOW})::bigint as expired from b""")
def st1_a24_g20_blacklist(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("token"), F.col("ts").alias("blacklisted_at"), (F.col("ts") + F.expr("interval 5 days")).alias("expires_at"))
    return state.blacklist_stats(rows, F.expr(_NOW))


@query(f"select event_id from events where ts >= {_NOW} - interval 10 days")
def st2_g21_retention(spark, sf_dir):
    return state.retained(table(spark, sf_dir, "events"), F.expr(_NOW), 10, "ts").select("event_id")


@query("select date_trunc('hour', ts) as window_start, event_type, count(*)::bigint as n, round(sum(value), 2) as total from events group by 1, 2")
def st3_activity_windows(spark, sf_dir):
    return state.activity_counts(table(spark, sf_dir, "events"))
