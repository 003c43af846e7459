"""Metrics, cleaning and evaluation of whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsieve.functions import lexicons as L
from quillsieve.functions import metrics as M
from quillsieve.functions import text as T
from quillsieve.operators import clean, evaluate
from quillsieve.operators.punctuation import project_punctuation, rule_completer
from quillsieve.plans.registry import Registry, documents, table
from quillsieve.plans.text_queries import DETECTED_SQL, FILLERS_SQL, SPACE_SQL, WORDS_SQL, digest
from quillsieve.sources.config import checkpointed

query = Registry()

_WORD_SQL = L.WORD.replace("'", "''")
#: Words, lower-cased words, sentence sizes and stray commas of ``text`` in a relation ``t`` (doc_id, lang, text).
_FEW = f"len(regexp_split_to_array(trim(text, ' '), '{SPACE_SQL}+')) <= 2500"
_PARTS = rf"""
    w as (select doc_id, lang, text, {WORDS_SQL} as w, {FILLERS_SQL} as listed,
      len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_replace(x, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g') <> '')) as sentences,
      string_split(regexp_replace(regexp_replace(text, ',(?:{SPACE_SQL}*,)+', ',', 'g'), ',{SPACE_SQL}*([.;:!?])', '\1', 'g'), ',') as p from t),
    p as (select *, list_transform(w, lambda x: lower(x)) as low, len(text) - len(replace(text, ',', '')) - coalesce(list_sum(list_transform(p, lambda x, i: case when i > 1 and
      regexp_matches(p[i - 1], '[\p{{L}}\p{{N}}]{SPACE_SQL}*$') and regexp_matches(x, '^{SPACE_SQL}*[\p{{L}}\p{{N}}]') then 1 else 0 end)), 0) as commas from w),
    m as (select doc_id, lang, text, w, low, commas, sentences, len(w) as n, len(list_distinct(low)) as kinds,
      len(list_filter(low, lambda x: list_contains(listed, x))) as fillers,
      len(list_filter(low, lambda x, i: i > 1 and x = low[i - 1])) as repeats,
      case when sentences > 0 then len(w)::double / sentences else len(w)::double end as average from p),
    q as (select *, case when n > 0 then least(1.0::double, commas::double / n) else 1.0::double end as artifact, case when n > 0 then least(1.0::double, (fillers + repeats)::double / n) else 1.0::double end as residue,
      case when average <= 0 then 0.0::double when average between 8 and 25 then 1.0::double when average < 8 then average / 8 else greatest(0.0::double, 1 - (average - 25) / 40) end as shape,
      case when n = 0 then 0.0::double when n < 50 then kinds::double / n else list_sum(list_transform(range(1, n - 48), lambda i: len(list_distinct(low[i:i + 49]))))::double / (50 * (n - 49)) end as mattr from m)
"""


_CUT = "replace(replace(text, 'the ', ''), ' de ', ' ')"


@query(f"""
    with src as (select doc_id, lang, {_CUT} as text from documents), {DETECTED_SQL},
    t as (select doc_id, lang, text from detected), {_PARTS},
    o as (select doc_id, len({WORDS_SQL}) as before from documents),
    f as (select *, case when before > 0 then greatest(0.0::double, (before - n)::double / before) else 0.0::double end as noise from q join o using (doc_id))
    select doc_id, before::int as original_word_count, n::int as processed_word_count, round(round(noise, 10), 4) as noise_reduction_rate, round(round(case when n > 0 then kinds::double / n else 0 end, 10), 4) as lexical_diversity,
      round(round(mattr, 10), 4) as mattr_score, round(round(average, 10), 2) as avg_sentence_length, fillers::int as hesitation_count, lang as detected_language,
      round(round(artifact, 10), 4) as artifact_rate, commas::int as residual_comma_count,
      round(round(greatest(0, least(1, (shape * 0.4 + (1 - artifact) * 0.3 + (1 - residue) * 0.3) * case when noise > 0.75 then greatest(0, 1 - (noise - 0.75) / 0.25) else 1 end)), 10), 4) as quality_score from f
""")
def m12_analyze_documents(spark, sf_dir):
    """Texts without some frequent words, against the whole ones."""
    columns = "doc_id original_word_count processed_word_count noise_reduction_rate lexical_diversity mattr_score avg_sentence_length hesitation_count detected_language artifact_rate residual_comma_count quality_score"
    rows = documents(spark, sf_dir).withColumn("cut", F.expr(_CUT))
    return clean.analyze(rows, "cut", reference="text").select(*columns.split())


@query(f"""
    with w as (select doc_id, list_transform({WORDS_SQL}, lambda x: lower(x)) as w from documents),
    d as (select doc_id, w from w union all select doc_id, list_reverse(w) as w from w),
    s as (select doc_id, len(w) as k, list_reduce(list_transform(w, lambda x: {{'w': x, 'seen': []::varchar[], 'n': 0::int, 'f': 0.0::double}}),
      lambda a, b: case when len(a.seen) + case when list_contains(a.seen, b.w) then 0 else 1 end <= 0.72::double * (a.n + 1) then {{'w': b.w, 'seen': []::varchar[], 'n': 0::int, 'f': (a.f + 1)::double}}
        when list_contains(a.seen, b.w) then {{'w': b.w, 'seen': a.seen, 'n': (a.n + 1)::int, 'f': a.f}}
        else {{'w': b.w, 'seen': list_append(a.seen, b.w), 'n': (a.n + 1)::int, 'f': a.f}} end,
      {{'w': '', 'seen': []::varchar[], 'n': 0::int, 'f': 0.0::double}}) as s from d),
    f as (select doc_id, k, s.f + case when s.n > 0 and len(s.seen) < s.n then (1 - len(s.seen)::double / s.n) / (1 - 0.72::double) else 0 end as f from s),
    m as (select doc_id, max(k) as k, sum(case when f > 0 then k / f else k end) / 2 as mtld from f group by doc_id)
    select doc_id, case when k >= 10 then round(mtld, 4) end as mtld from m
""")
def m1_m2_mtld(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.round(M.mtld(T.words("text")), 4).alias("mtld"))


@query(f"""
    with t as (select doc_id, lang, text from documents), {_PARTS},
    s as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: len(regexp_extract_all(x, '{_WORD_SQL}'))), lambda k: k > 0) as sizes,
      n, list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '{L.VOWELS}'))))) as syllables from m)
    select doc_id, round(case when n > 0 and len(sizes) > 0 then greatest(0, least(100, 206.835::double - 1.015::double * (n::double / len(sizes)) - 84.6::double * (syllables::double / n))) else 0 end, 6) as flesch,
      round(case when len(sizes) > 0 then coalesce(list_sum(list_filter(sizes, lambda k: k > 40)), 0)::double / list_sum(sizes) else 1 end, 6) as run_on_rate from s
""")
def m13_m14_readability(spark, sf_dir):
    rows = documents(spark, sf_dir)
    return rows.select("doc_id", F.round(M.flesch("text", "lang"), 6).alias("flesch"), F.round(M.run_on_rate("text"), 6).alias("run_on_rate"))


@query(f"""
    with r as (select doc_id, strip_accents(lower(unnest({WORDS_SQL}))) as w, list_transform({FILLERS_SQL}, lambda x: strip_accents(x)) as listed from documents),
    a as (select doc_id, w, count(*) as n from r where not list_contains(listed, w) group by all),
    b as (select doc_id, w, count(*) as m from (select doc_id, strip_accents(lower(unnest({WORDS_SQL}))) as w from (select doc_id, {_CUT} as text from documents)) group by all),
    k as (select doc_id, sum(least(n, coalesce(m, 0)))::double / sum(n) as kept from a left join b using (doc_id, w) group by doc_id)
    select doc_id, round(coalesce(kept, 1), 6) as retention from documents left join k using (doc_id)
""")
def m15_j7_content_retention(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("cut", F.expr(_CUT))
    return evaluate.content_retention(rows, "doc_id", "text", "cut", "lang").withColumn("retention", F.round("retention", 6))


@query("""
    with v as (select l_orderkey, l_linenumber, l_quantity::double as average, l_discount::double as artifact, l_tax::double * 5 as residue, (l_suppkey % 21) / 20.0::double as noise from lineitem)
    select l_orderkey, l_linenumber, round((case when average <= 0 then 0 when average between 8 and 25 then 1 when average < 8 then average / 8 else greatest(0, 1 - (average - 25) / 40) end * 0.4 + (1 - artifact) * 0.3 + (1 - residue) * 0.3)
      * case when noise > 0.75 then greatest(0, 1 - (noise - 0.75) / 0.25) else 1 end, 6) as quality from v
""")
def m5_m9_quality_formula(spark, sf_dir):
    number = lambda c: F.col(c).cast("double")
    rows = table(spark, sf_dir, "lineitem")
    scored = M.quality(number("l_quantity"), number("l_discount"), number("l_tax") * 5, (F.col("l_suppkey") % 21) / F.lit(20.0))
    return rows.select("l_orderkey", "l_linenumber", F.round(scored, 6).alias("quality"))


@query()
def m11_process_documents(spark, sf_dir):
    done = clean.process(documents(spark, sf_dir))
    return done.select("doc_id", digest(F.col("processed_text")).alias("processed_sha"), "processed_word_count", "noise_reduction_rate", "hesitation_count", "repetition_count", "timestamp_markers_removed", "mtld_score", "mattr_score", "quality_score")


@query()
def r1_r4_process_with_punctuation(spark, sf_dir):
    rows = documents(spark, sf_dir).withColumn("text", F.lower(F.regexp_replace("text", "[.,!?;:]", "")))
    done = clean.process(rows, completer=rule_completer)
    return done.select("doc_id", "punctuation_restored", "processed_word_count", "quality_score", digest(F.col("processed_text")).alias("processed_sha"))


@query(rf"""
    with t as (select doc_id, list_filter(regexp_split_to_array(text, '{SPACE_SQL}+'), lambda w: w <> '') as w from documents),
    m as (select doc_id, w, list_transform(w, lambda x, i: case when regexp_full_match(x, '[\p{{L}}]+') and x = lower(x) and x[1] <> 'ß' then case when i % 3 = 0 then upper(x[1]) || x[2:] else x end || case when i % 4 = 0 then '?' else '' end else x end) as v from t)
    select doc_id, case when len(w) = 0 then sha256((select text from documents d where d.doc_id = m.doc_id)) else sha256(array_to_string(v, ' ')) end as projected_sha from m
""")
def r2_projected_marks(spark, sf_dir):
    """A proposal that capitalises every third plain word and asks after every fourth gives just that; words stay."""
    plain = lambda x: x.rlike(r"^\p{L}+$") & (x == F.lower(x)) & ~x.startswith("ß")

    def proposed(x, k):
        shaped = F.concat(F.when((k + 1) % 3 == 0, T.capital(x)).otherwise(x), F.when((k + 1) % 4 == 0, "?").otherwise(""))
        return F.when(plain(x), shaped).otherwise(x)

    tokens = F.filter(F.split("text", r"(?U)\s+", -1), lambda w: w != "")
    rows = documents(spark, sf_dir).withColumn("proposal", F.array_join(F.transform(tokens, proposed), " "))
    return rows.select("doc_id", digest(project_punctuation(F.col("text"), F.col("proposal"))).alias("projected_sha"))


@query(f"""
    with dict as (select lang, unnest(list_distinct(list_transform({WORDS_SQL}, lambda x: lower(x)))) as w from documents)
    select lang, count(distinct w)::bigint as words, count(distinct strip_accents(w))::bigint as keys from dict where length(w) >= 3 group by lang
""")
def t18_dictionary(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("lang", F.explode(T.lower_words("text")).alias("word")).where(F.length("word") >= 3).distinct()
    return words.groupBy("lang").agg(F.count("*").alias("words"), F.count_distinct(T.fold("word")).alias("keys"))


@query(rf"""
    with d as (select lang, w, count(*) as n from (select lang, unnest({WORDS_SQL}) as x, lower(x) as w from documents) where length(w) >= 3 and regexp_full_match(w, '\p{{L}}+') group by all),
    best as (select lang, strip_accents(w) as k, arg_max(w, (n, w)) as best from d group by all),
    p as (select doc_id, lang, unnest(parts) as p, generate_subscripts(parts, 1) as pos from (select doc_id, lang, regexp_extract_all(strip_accents(text), '{L.WORD_OR_GAP.replace("'", "''")}') as parts from documents where {_FEW})),
    r as (select doc_id, pos, p, best, length(p) >= 3 and regexp_full_match(p, '\p{{L}}+') and best is not null and d.w is null as take from p
      left join best on best.lang = p.lang and best.k = strip_accents(lower(p)) left join d on d.lang = p.lang and d.w = lower(p)),
    j as (select doc_id, sha256(string_agg(case when not take then p when p[1] <> lower(p)[1] then upper(best[1]) || best[2:] else best end, '' order by pos)) as text_sha, count(*) filter (take) as words from r group by doc_id)
    select doc_id, coalesce(text_sha, sha256(strip_accents(text))) as text_sha from documents left join j using (doc_id)
""")
def t18_accents_restored(spark, sf_dir):
    """Texts whose accents were taken off, restored from the words of the texts as they were; words that also stand without accents stay."""
    docs = documents(spark, sf_dir)
    words = docs.select("lang", F.explode(F.filter(T.lower_words("text"), lambda w: (F.length(w) >= 3) & w.rlike(r"^\p{L}+$"))).alias("word"))
    dictionary = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    rows = docs.withColumn("text", F.translate("text", *L.accent_folds()))
    # the bound of the SQL above; the operator has none of its own
    return clean.restore_accents(rows, dictionary, "text", "lang", F.lit(True), most=2500).select("doc_id", digest(F.col("text")).alias("text_sha"))


@query("select doc_id, length(text) % 2 = 1 as spelling_failed, sha256(case when length(text) % 2 = 1 then text else replace(text, ' the ', ' THE ') end) as text_sha from documents")
def st10_spelling_retry(spark, sf_dir):
    """A speller that fails on some texts: these go on without it."""

    def speller(text: str, lang: str) -> str:
        if len(text) % 2:
            raise ValueError("no spelling")
        return text.replace(" the ", " THE ")

    rows = clean.spelled(documents(spark, sf_dir), speller, "text", "lang")
    return rows.select("doc_id", "spelling_failed", digest(F.col("text")).alias("text_sha"))


def _evaluated(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", T.normalize_language("lang").alias("lang"), F.coalesce("text", F.lit("")).alias("raw"))
    rows = rows.withColumn("processed", T.normalize_sentences(T.strip_orphan_commas(F.replace("raw", F.lit(","), F.lit(" ,")))))
    return checkpointed(evaluate.evaluate_documents(rows, "doc_id", "raw", "processed", "lang").drop("raw", "processed"))


@query()
def m16_m17_evaluate_documents(spark, sf_dir):
    return _evaluated(spark, sf_dir)


@query()
def a13_a14_a16_paired_stats(spark, sf_dir):
    return evaluate.paired_stats(_evaluated(spark, sf_dir), "doc_id")


@query()
def a13_k9_metrics_report(spark, sf_dir):
    rows = _evaluated(spark, sf_dir)
    return evaluate.metrics_report(evaluate.paired_stats(rows, "doc_id"), evaluate.paired_intervals(rows, "doc_id"))


@query()
def a21_retention_summary(spark, sf_dir):
    return evaluate.retention_summary(_evaluated(spark, sf_dir))


_PAIRED = """
    with v as (select l_returnflag as g, l_orderkey, l_linenumber, l_quantity::double as a, l_quantity::double + (l_tax * 100 - 4)::double as b from lineitem),
    d as (select g, b - a as delta, a, b from v),
    r as (select g, delta, rank() over (partition by g order by abs(delta)) + (count(*) over (partition by g, abs(delta)) - 1) / 2.0 as rk from d where delta <> 0)
"""


@query(_PAIRED + """
    select g as stratum, count(*)::bigint as n, round(avg(a), 6) as raw, round(avg(b), 6) as processed, round(avg(delta), 6) as delta, round(avg((delta > 0)::int), 6) as improved, round(avg((delta < 0)::int), 6) as worsened,
      (select round(sum(sign(delta) * rk) / sum(rk), 6) from r where r.g = d.g) as effect from d group by g
""")
def a13_a14_paired_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("group"), F.col("l_quantity").cast("double").alias("a"), ((F.col("l_tax") * 100 - 4).cast("double")).alias("d"))
    metrics = [n for n, _, _ in evaluate.METRICS]
    wide = rows.select("l_orderkey", "group", *[F.col("a").alias(f"raw_{m}") for m in metrics], *[(F.col("a") + F.col("d")).alias(f"processed_{m}") for m in metrics])
    stats = evaluate.paired_stats(wide, "l_orderkey").where("metric = 'flesch' and stratum <> 'all'")
    return stats.select("stratum", "n", *[F.round(c, 6).alias(c) for c in ("raw", "processed", "delta", "improved", "worsened", "effect")])
