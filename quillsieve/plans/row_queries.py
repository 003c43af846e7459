"""Transcript rows, playlists, outcomes and exports over the tables.

Documents stand for transcripts and their sources for playlists; orders stand for a
playlist's rows and customers for playlists.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsieve.functions import lexicons as L
from quillsieve.functions import text as T
from quillsieve.operators import export, outcomes, playlists
from quillsieve.plans.registry import Registry, table
from quillsieve.sources import tables

query = Registry()

#: Expressions that Spark and DuckDB read alike.
_TRANSCRIPT = {
    "id": "cast(doc_id as string)",
    "title": "concat('Title \"', lang, '\", ', source)",
    "youtubeId": "concat('vid', lpad(cast(doc_id as string), 8, '0'))",
    "playlistId": "source",
    "language": "lang",
    "content": "text",
    "processedContent": "case when lang = 'de' then ' ' when lang = 'fr' then null else replace(text, '. ', '.  ') end",
    "qualityScore": "cast(quality as double) * 0.5 + 0.25",
    "mtldScore": "cast(case when n_chars > 1000 then n_chars end as double) / 4",
    "mattrScore": "cast(0.5 as double)",
    "llmCurationScore": "cast(quality as double) * 0.5",
    "coherence": "cast(quality as double) * 5",
    "richness": "cast(quality as double) + 4.5",
    "factuality": "cast(quality as double) + 7",
    "curationOverall": "cast(quality as double) * 2 + 4.5",
    "curationRationale": "case when quality = 1 then concat('fine', chr(10), '>>>', chr(10), '<ok> & \"so\"') end",
    "curationProvider": "case when quality is not null then 'stub' end",
    "curationModel": "case when quality is not null then 'hash' end",
    "curationChunkCount": "case when quality is not null then cast(1 as int) end",
    "status": "case when toxic = 1 then 'ERROR' when quality is null and n_chars > 5000 then 'PROCESSING' else 'COMPLETED' end",
    "deduplicationStatus": "case when n_chars < 400 then 'duplicate' when quality = 0 then 'pending' else 'kept' end",
    "dedupGroupId": "case when n_chars < 400 then concat('group-', lang) end",
}
_TRANSCRIPTS_SQL = (
    "t as (select doc_id, "
    + ", ".join(f'{v} as "{k}"' for k, v in _TRANSCRIPT.items())
    + " from documents left join labels using (doc_id))"
)


def transcripts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", *[F.expr(v).alias(k) for k, v in _TRANSCRIPT.items()])


def _choice_sql(stage: str) -> str:
    strip = lambda c: f"nullif(trim({c}, ' ' || chr(9) || chr(10) || chr(13)), '')"
    return strip("content") if stage == "raw" else f"coalesce({strip('\"processedContent\"')}, {strip('content')})"


def _disposition_sql(stage: str, duplicates: bool) -> str:
    rules = ["when status = 'ERROR' then 'failed'"]
    rules += [] if duplicates else ["when \"deduplicationStatus\" = 'duplicate' then 'duplicate'"]
    rules += ["when \"curationOverall\" is null then 'dropped'"] if stage == "curated" else []
    return f"case {' '.join(rules)} when {_choice_sql(stage)} is null then 'failed' else 'exported' end"


def _admitted(spark, sf_dir, stage: str, duplicates: bool):
    rows = transcripts(spark, sf_dir).withColumn("text", export.export_text(stage, "content", "processedContent"))
    kind = export.disposition(stage, duplicates, F.col("status"), F.col("deduplicationStatus"), F.col("curationOverall").isNotNull(), F.col("text"))
    return rows.withColumns({"disposition": kind, "dataset": F.lit(stage)})


_SETTINGS = [(s, d) for s in export.STAGES for d in (False, True)]


@query(f"with {_TRANSCRIPTS_SQL} " + " union all ".join(
    f"""select '{s}' as stage, {str(d).lower()} as with_duplicates, count(*) filter (k = 'exported')::bigint as records, count(*) filter (k = 'duplicate')::bigint as "skippedDuplicates",
    count(*) filter (k = 'failed')::bigint as "skippedFailed" from (select {_disposition_sql(s, d)} as k from t)""" for s, d in _SETTINGS))  # fmt: skip
def p3_export_admission(spark, sf_dir):
    counts = [export.export_counts(_admitted(spark, sf_dir, s, d)).select(F.lit(s).alias("stage"), F.lit(d).alias("with_duplicates"), "*") for s, d in _SETTINGS]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def _record_query(fmt: str):
    def run(spark, sf_dir):
        rows = _admitted(spark, sf_dir, "curated", False).where("disposition = 'exported'")
        return export.serialize(rows, fmt, ["doc_id"])

    return run


_EXPORTED = f"{_TRANSCRIPTS_SQL}, x as (select *, 'curated' as dataset, {_choice_sql('curated')} as \"text\" from t where {_disposition_sql('curated', False)} = 'exported')"
_NUMERIC = {"qualityScore", "mtldScore", "mattrScore", "llmCurationScore", "coherence", "richness", "factuality", "curationOverall", "curationChunkCount"}


def _shown(f: str) -> str:
    return f"regexp_replace(\"{f}\"::varchar, '\\.0$', '')" if f in _NUMERIC else f'"{f}"::varchar'


def _one_line(x: str) -> str:
    return f"regexp_replace({x}, '\\r?\\n', ' ', 'g')"


def _record_sql(fmt: str) -> str:
    nl = "chr(10)"
    if fmt == "json":
        lines = [f"'    \"{f}\": ' || coalesce({_shown(f) if f in _NUMERIC else f'to_json({_shown(f)})::varchar'}, 'null')" for f in export.FIELDS]
        return f"'  {{' || {nl} || concat_ws(',' || {nl}, {', '.join(lines)}) || {nl} || '  }}'"
    if fmt == "csv":
        cells = [f"""case when regexp_matches(coalesce({_shown(f)}, ''), '[",\\n\\r]') then '"' || replace({_shown(f)}, '"', '""') || '"' else coalesce({_shown(f)}, '') end""" for f in export.FIELDS]
        return " || ',' || ".join(cells)
    if fmt == "txt":
        lines = [f"'{f}: ' || coalesce({_one_line(_shown(f))}, '')" for f in export.SCALARS]
        body = f"array_to_string(list_transform(string_split(replace(\"text\", chr(13) || {nl}, {nl}), {nl}), lambda x: case when x in ('>>>', '<<<RECORD>>>', '<<<END>>>') then '\\' || x else x end), {nl})"
        return f"concat_ws({nl}, '<<<RECORD>>>', {', '.join(lines)}, 'text<<<' || {nl} || {body} || case when \"text\" = '' or ends_with(\"text\", {nl}) then '' else {nl} end || '>>>', '<<<END>>>')"
    if fmt == "md":
        lines = [f"'{f}: ' || coalesce({_shown(f) if f in _NUMERIC else f'to_json({_one_line(_shown(f))})::varchar'}, 'null')" for f in export.SCALARS]
        return f"concat_ws({nl}, '---', {', '.join(lines)}, '---', '', '## text' || {nl} || {nl} || trim(replace(\"text\", chr(13) || {nl}, {nl}), ' ' || {nl} || chr(9)))"
    rows = []
    for f in export.FIELDS:
        x = f"coalesce({_shown(f)}, '')"
        for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
            x = f"replace({x}, '{old}', '{new}')"
        rows.append(f"'    <{f}>' || {x} || '</{f}>'")
    return f"'  <record>' || {nl} || concat_ws({nl}, {', '.join(rows)}) || {nl} || '  </record>'"


for _k, _fmt in enumerate(("json", "csv", "txt", "md", "xml"), 1):
    _f = _record_query(_fmt)
    _f.__name__ = f"k{_k}_export_{_fmt}"
    query(f"with {_EXPORTED} select doc_id, {_record_sql(_fmt)} as record from x")(_f)


@query("select n_name, concat('playlist-', n_nationkey, '-curated.csv') as file from nation")
def k7_export_names(spark, sf_dir):
    name = export.export_filename(F.lit("playlist"), F.col("n_nationkey").cast("string"), F.lit("curated"), F.lit("csv"))
    return table(spark, sf_dir, "nation").select("n_name", name.alias("file"))


_STATUS = "case o_orderstatus when 'F' then 'ERROR' when 'O' then 'COMPLETED' else 'PROCESSING' end"
_ROWS_SQL = f"r as (select o_custkey, o_orderkey, {_STATUS} as status, cast(floor(o_totalprice) as bigint) as word_count, o_orderdate from orders)"


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.expr(_STATUS).alias("status"), F.floor("o_totalprice").cast("long").alias("word_count"), "o_orderdate")


_SUMMARY_SQL = f"""{_ROWS_SQL}, c as (select o_custkey, count(*) filter (status = 'ERROR') as failed, count(*) filter (status = 'PROCESSING') as processing, count(*) filter (status = 'COMPLETED') as completed,
    coalesce(sum(word_count) filter (status = 'COMPLETED'), 0)::bigint as total_word_count from r group by all),
    s as (select o_custkey, case when processing > 0 then 'PROCESSING' when failed > 0 and completed = 0 then 'ERROR' else 'COMPLETED' end as status,
    case when processing = 0 and failed > 0 then failed || '{L.FAILED_SUFFIX}' end as error_message, total_word_count, failed, processing, completed from c)"""


@query(f"with {_SUMMARY_SQL} select * from s")
def a1_g7_playlist_summary(spark, sf_dir):
    return playlists.summarize(_rows(spark, sf_dir), "o_custkey")


@query(f"""with {_SUMMARY_SQL} select c_custkey, coalesce(floor(100 * (completed + failed)::double / nullif(c_nationkey, 0) + 0.5)::bigint, case when status = 'COMPLETED' then 100 else 0 end) as progress
    from s join customer on o_custkey = c_custkey""")
def a4_progress(spark, sf_dir):
    summary = playlists.summarize(_rows(spark, sf_dir), "o_custkey").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return summary.select("c_custkey", playlists.progress(summary, "c_nationkey").alias("progress"))


@query(f"""with {_TRANSCRIPTS_SQL} select count(*) filter ("processedContent" is not null)::bigint as processed, count(*) filter ("deduplicationStatus" <> 'pending')::bigint as deduplicated,
    count("llmCurationScore")::bigint as curated, count(*) filter ("deduplicationStatus" = 'duplicate')::bigint as duplicates, count(*) filter (status = 'ERROR')::bigint as failed, round(avg("qualityScore"), 6) as average_quality from t""")
def a5_a6_panel_counters(spark, sf_dir):
    rows = transcripts(spark, sf_dir).select(
        "status", F.col("processedContent").isNotNull().alias("is_processed"), F.col("deduplicationStatus").alias("deduplication_status"), F.col("llmCurationScore").alias("curation_score"), F.col("qualityScore").alias("quality_score")
    )
    return playlists.panel_counts(rows).withColumn("average_quality", F.round("average_quality", 6))


@query(f"""with {_TRANSCRIPTS_SQL} select "playlistId", case max(case when "llmCurationScore" is not null then 2 when "processedContent" is not null then 1 else 0 end) when 2 then 'curated' when 1 then 'processed' else 'raw' end as stage from t group by 1""")
def a7_p15_furthest_stage(spark, sf_dir):
    rows = transcripts(spark, sf_dir).select("playlistId", F.col("llmCurationScore").alias("curation_score"), F.col("processedContent").isNotNull().alias("is_processed"))
    return playlists.furthest_playlist_stage(rows, "playlistId")


@query("select conv_id, min(turn * 1000 + length(role))::bigint as first_row, array_to_string(list(role order by turn, turn * 1000 + length(role), role), ',') as roles from conversations group by conv_id")
def a8_grouped_jobs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("at", (F.col("turn") * 1000 + F.length("role")).cast("long"))
    grouped = playlists.group_jobs(rows, "conv_id", "at", "turn", ["role"])
    return grouped.select("conv_id", "first_row", F.array_join(F.transform("members", lambda m: m["role"]), ",").alias("roles"))


@query("select count(*)::bigint as n, sum(l_quantity)::double as total, sum(l_linenumber)::bigint as positions from lineitem")
def a2_a3_counts_and_sums(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("total"), F.sum("l_linenumber").cast("long").alias("positions"))


@query("""select conv_id, array_to_string(list(text order by turn, text), ' ') as raw_text, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))::bigint as word_count, max(turn + 2.5)::double as duration_seconds
    from conversations group by conv_id""")
def a23_caption_assembly(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    snippets = F.array_sort(F.collect_list(F.struct("turn", "text", F.col("turn").cast("double").alias("start"), F.lit(2.5).alias("duration"))))
    built = rows.groupBy("conv_id").agg(tables.assemble_caption(snippets).alias("c"))
    return built.select("conv_id", "c.raw_text", F.col("c.word_count").cast("long").alias("word_count"), F.col("c.duration_seconds").cast("double").alias("duration_seconds"))


@query("select o_orderkey, c_name, c_mktsegment from orders left join customer on o_custkey = c_custkey")
def j1_rows_with_playlist(spark, sf_dir):
    named = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return playlists.with_playlist(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), named, "o_custkey").drop("o_custkey")


@query("""select c_custkey, coalesce(array_to_string(list(o_orderkey order by o_orderdate, o_orderkey) filter (o_orderkey is not null), ','), '') as members from customer left join orders on o_custkey = c_custkey group by c_custkey""")
def j2_g9_playlists_with_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("day"))
    built = playlists.with_members(table(spark, sf_dir, "customer").select("c_custkey"), rows, "c_custkey", "day", ["o_orderkey"])
    return built.select("c_custkey", F.array_join(F.transform("members", lambda m: m["o_orderkey"].cast("string")), ",").alias("members"))


@query("select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def j3_rows_of_a_channel(spark, sf_dir):
    lists = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("channel_id"))
    return playlists.in_channel(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), lists, "BUILDING", "o_custkey").select("o_orderkey")


@query("select o_orderkey, case when o_custkey in (select c_custkey from customer where c_acctbal < 0) then 'HELD' else o_orderstatus end as o_orderstatus, coalesce(nullif(p, ''), o_orderpriority) as o_orderpriority from orders left join (select c_custkey, case when c_acctbal < 0 then 'none' else '' end as p from customer) on c_custkey = o_custkey")
def j10_k10_patched_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    held = playlists.patch_ids(rows, poor, "o_custkey", {"o_orderstatus": F.lit("HELD")})
    return playlists.patch(held, poor.withColumn("o_orderpriority", F.lit("none")), "o_custkey").drop("o_custkey")


@query("""select conv_id, turn, case when hit and role <> 'system' then 'ERROR' else case when role = 'system' then 'COMPLETED' else 'PROCESSING' end end as status, hit and role <> 'system' as cancelled from
    (select *, coalesce(max((length(text) > 600)::int) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) = 1 as hit from (select distinct on (conv_id, turn) conv_id, turn, role, text from conversations order by conv_id, turn, role, text))""")
def w3_g5_cancel_after_rate_limit(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("f")).select("conv_id", "turn", "f.*")
    rows = first.select("conv_id", "turn", F.when(F.col("role") == "system", "COMPLETED").otherwise("PROCESSING").alias("status"), F.lit(None).cast("string").alias("error_message"), (F.length("text") > 600).alias("rate_limited"))
    return playlists.cancel_after_rate_limit(rows, "conv_id", "turn").select("conv_id", "turn", "status", "cancelled")


_BLOCKED = f"case when o_totalprice > 300000 then upper('{L.RATE_LIMITED}') when o_totalprice < 2000 then 'other' end"


@query(f"""with r as (select o_orderkey, o_custkey, {_BLOCKED} as m from orders), f as (select o_orderkey, coalesce(contains(lower(m), '{L.RATE_LIMIT_MARKS[0]}'), false) as own, max(coalesce(contains(lower(m), '{L.RATE_LIMIT_MARKS[0]}'), false)::int) over (partition by o_custkey) = 1 as hit from r)
    select o_orderkey, case when hit then 'cancel' else 'resume' end as action, case when hit and own then '{L.RATE_LIMITED}' when hit then '{L.CANCELLED}' end as message from f""")
def w4_g8_resume_plan(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr(_BLOCKED).alias("error_message"))
    return playlists.resume_plan(rows, "o_custkey").select("o_orderkey", "action", "message")


@query("select o_orderkey, o_custkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc nulls last, o_orderkey desc) as rn from orders where o_totalprice > 20000) where rn = 1")
def w5_s7_latest_per_key(spark, sf_dir):
    return playlists.latest_per_key(table(spark, sf_dir, "orders").where("o_totalprice > 20000"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey")


@query("select o_orderkey, (select count(*) from orders)::bigint as total from orders order by o_orderdate desc nulls last, o_orderkey limit 5")
def o2_newest_rows(spark, sf_dir):
    return playlists.newest(table(spark, sf_dir, "orders"), "o_orderdate", 5, "o_orderkey").select("o_orderkey", "total")


@query("select event_id, user_id, event_type from events order by ts desc, event_id")
def o1_o3_recent_activity(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), "event_id").select("event_id", "user_id", "event_type")


@query("select o_orderkey from orders where o_orderstatus = 'O' and o_orderpriority <> '' and o_orderdate < date '1996-01-01' order by o_orderdate, o_orderkey limit 50" )
def p19_o4_reprocess_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "COMPLETED").alias("status"), F.col("o_orderpriority").alias("content"), F.col("o_orderdate").alias("updated_at"))
    return playlists.reprocess_candidates(rows, F.lit("1996-01-01").cast("date"), 50).select(F.col("id").alias("o_orderkey"))


_CAPTION = "cast(e.event_id as string) as video_id, event_type <> 'error' and value > 5 as success, case when value > 90 then ' ' when value > 80 then '' else props end as raw_text, cast(case when value > 50 then floor(value) else 0 end as int) as word_count, case when user_id > 75 then 'pt' end as language_code, case when value < 1 then 'rate_limited' when value < 2 then 'no_transcript' when value < 3 then 'execution_error' when value < 4 then 'video_unavailable' when value < 4.5 then 'invalid_url' end as error_type, case when user_id % 2 = 0 then 'Timeout hit' when user_id % 3 = 0 then 'RequestBlocked' end as error"
_LIMITED_SQL = f"(coalesce(error_type, '') = 'rate_limited' or (coalesce(error_type, '') = 'execution_error' and contains(lower(coalesce(error, '')), 'timeout')) or {' or '.join(f'contains(lower(coalesce(error, {chr(39) * 2})), {chr(39)}{m}{chr(39)})' for m in L.BLOCK_MARKS)})"
_MESSAGE_SQL = f"case when {_LIMITED_SQL} then '{L.RATE_LIMITED}' " + " ".join(f"when error_type = '{k}' then '{v}'" for k, v in L.CAPTION_MESSAGES.items()) + f" else '{L.CAPTION_FAILED}' end"


def _captions(spark, sf_dir):
    return table(spark, sf_dir, "events").alias("e").selectExpr(*_split_select(_CAPTION))


def _split_select(text: str) -> list[str]:
    """The expressions of a select list, cut at commas outside brackets."""
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


@query(f"""with c as (select {_CAPTION} from events e), d as (select *, success and trim(raw_text) <> '' as done from c)
    select video_id, case when done then 'COMPLETED' else 'ERROR' end as status, case when done then raw_text end as content, case when not done then {_MESSAGE_SQL} end as error_message,
    case when done and word_count > 0 then word_count end as word_count, case when done then coalesce(nullif(language_code, ''), 'en') else 'en' end as language from d""")
def p7_p9_p10_single_outcomes(spark, sf_dir):
    c = [F.col(x) for x in ("success", "raw_text", "word_count", "language_code", "error_type", "error")]
    return _captions(spark, sf_dir).select("video_id", outcomes.single_outcome(*c).alias("o")).select("video_id", "o.*")


@query(f"""with c as (select {_CAPTION} from events e), d as (select *, coalesce(success and raw_text <> '', false) as done from c)
    select video_id, case when done then 'completed' else 'failed' end as kind, case when done then raw_text end as content, case when done then coalesce(word_count, 0) end as word_count,
    case when done then language_code end as language, case when not done then {_MESSAGE_SQL} end as error_message, not done and {_LIMITED_SQL} as rate_limited from d""")
def p8_g6_playlist_outcomes(spark, sf_dir):
    c = [F.col(x) for x in ("success", "raw_text", "word_count", "language_code", "error_type", "error")]
    return _captions(spark, sf_dir).select("video_id", outcomes.playlist_outcome(*c).alias("o")).select("video_id", "o.*")


_CLASSES = "case user_id % 9 when 0 then 'IpBlocked' when 1 then 'Timeout' when 2 then 'NoTranscriptFound' when 3 then 'TranscriptsDisabled' when 4 then 'AgeRestricted' when 5 then 'InvalidVideoId' else 'Other' end"
_SAID = "case when value > 60 then 'read timeOUT' when value < 20 then 'HTTP 429' else 'boom' end"


@query(f"""select event_id, case when c in ('IpBlocked', 'RequestBlocked', 'Timeout') then 'rate_limited' when c in ('NoTranscriptFound', 'TranscriptsDisabled') then 'no_transcript' when c in ('VideoUnavailable', 'VideoUnplayable', 'AgeRestricted') then 'video_unavailable'
    when c = 'InvalidVideoId' then 'invalid_video_id' when contains(lower(m), 'timeout') or contains(m, '429') then 'rate_limited' else 'api_error' end as error_type, length(event_id::varchar) >= 8 as valid from (select event_id, {_CLASSES} as c, {_SAID} as m from events)""")
def p11_p12_error_types(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", outcomes.classify_error(F.expr(_CLASSES), F.expr(_SAID)).alias("error_type"), outcomes.valid_video_id(F.col("event_id").cast("string")).alias("valid"))


@query(f"""select o_orderkey, case when o_orderstatus <> 'F' or o_totalprice > 200000 then 'rejected' else 'started' end as outcome,
    case when o_orderstatus <> 'F' then '{L.NOT_AN_ERROR}' when o_totalprice > 200000 then '{L.STILL_PROCESSING}' end as message from orders""")
def p13_g3_single_retries(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "ERROR").otherwise("COMPLETED")
    return table(spark, sf_dir, "orders").select("o_orderkey", outcomes.single_retry(status, F.col("o_totalprice") > 200000).alias("r")).select("o_orderkey", "r.*")


@query(f"""select c_custkey, case when n > 0 then 'started' else 'rejected' end as outcome, case when n = 0 then '{L.NOTHING_TO_RETRY}' end as message, case when n > 0 then n end as retried
    from (select c_custkey, count(o_orderkey) filter (o_orderstatus = 'F')::bigint as n from customer left join orders on c_custkey = o_custkey group by 1)""")
def p13_g4_batch_retries(spark, sf_dir):
    failed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(failed, "c_custkey", "left")
    return rows.select("c_custkey", outcomes.batch_retry(F.coalesce("n", F.lit(0)).cast("long")).alias("r")).select("c_custkey", "r.*")


@query(f"""with {_TRANSCRIPTS_SQL} select doc_id, case when content = '' then 'extracted' when "processedContent" is null then 'processed' when "deduplicationStatus" = 'pending' then 'deduplicated' when "llmCurationScore" is null then 'curated' end as step,
    case when "llmCurationScore" is not null then 'curated' when "processedContent" is not null then 'processed' else 'raw' end as furthest, case when "qualityScore" >= 0.75 then 'good' when "qualityScore" >= 0.5 then 'fair' else 'poor' end as tone,
    "deduplicationStatus" in ('pending', 'duplicate') or "llmCurationScore" is not null as skipped, case when "deduplicationStatus" = 'pending' then 'pending' when trim(content) = '' then 'blank' end as blocked from t""")
def p5_p6_p14_p16_stages(spark, sf_dir):
    c = F.col
    return transcripts(spark, sf_dir).select(
        "doc_id",
        outcomes.pipeline_step(c("content") != "", c("processedContent").isNotNull(), c("deduplicationStatus") != "pending", c("llmCurationScore").isNotNull()).alias("step"),
        outcomes.furthest_stage(c("llmCurationScore"), c("processedContent").isNotNull()).alias("furthest"),
        outcomes.quality_tone(c("qualityScore")).alias("tone"),
        outcomes.skip_batch_curation(c("deduplicationStatus"), c("llmCurationScore")).alias("skipped"),
        outcomes.single_curation_block(c("deduplicationStatus"), c("content")).alias("blocked"),
    )


@query(f"""with {_TRANSCRIPTS_SQL} select "playlistId", count(*)::bigint as n from t where status = 'COMPLETED' and "llmCurationScore" is not null and trim(content) <> '' group by 1""")
def p18_preview_counts(spark, sf_dir):
    rows = transcripts(spark, sf_dir).where("status = 'COMPLETED' and llmCurationScore is not null").where(T.blank_to_null("content").isNotNull())
    return rows.groupBy("playlistId").agg(F.count("*").alias("n"))


@query("""select doc_id, case when doc_id % 4 = 0 then 1 when doc_id % 4 = 1 then 5 else doc_id % 4 end::int as runs,
    least(120000 + 90000 * greatest(1, least(10, ceil(n_chars / 6000)::bigint)) * 2, 1800000)::bigint as timeout_ms from documents""")
def p22_runs_and_timeouts(spark, sf_dir):
    runs = F.when(F.col("doc_id") % 4 == 0, "x").when(F.col("doc_id") % 4 == 1, "99").otherwise((F.col("doc_id") % 4).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", outcomes.judge_runs(runs).alias("runs"), outcomes.curation_timeout_ms(F.col("n_chars"), F.lit(2)).alias("timeout_ms"))


@query("""select doc_id, case when x is null or isnan(x) or isinf(x) then null else round(greatest(0, least(10, x)), 2) end as score from (select doc_id, try_cast(case doc_id % 5 when 0 then 'high' when 1 then 'Infinity' when 2 then 'nan' when 3 then '12.5' else (doc_id / 100.0)::double::varchar end as double) as x from documents)""")
def p21_scores(spark, sf_dir):
    value = F.expr("case doc_id % 5 when 0 then 'high' when 1 then 'Infinity' when 2 then 'nan' when 3 then '12.5' else cast(cast(doc_id / 100.0 as double) as string) end")
    return table(spark, sf_dir, "documents").select("doc_id", T.score(value).alias("score"))


@query(f"select doc_id, n >= 20 and marks < 0.02::double * n as lacking from (select doc_id, len(regexp_extract_all(text, '{L.WORD.replace(chr(39), chr(39) * 2)}')) as n, len(regexp_extract_all(text, '[.!?]')) as marks from documents)")
def p23_needs_punctuation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.needs_punctuation("text").alias("lacking"))


@query("""
    select s_nationkey as video_id, arg_min(code || '/' || auto::varchar, (rank, auto, code)) as track from (select s_nationkey, case s_suppkey % 5 when 0 then 'pt-BR' when 1 then 'en' when 2 then 'it' when 3 then 'en-AU' else 'PT' end as code,
      s_suppkey % 2 = 0 as auto, case s_suppkey % 5 when 0 then 2 when 1 then 4 when 2 then 102 when 3 then 101 else 100 end as rank from supplier) group by 1""")
def o6_g15_caption_tracks(spark, sf_dir):
    code = F.expr("case s_suppkey % 5 when 0 then 'pt-BR' when 1 then 'en' when 2 then 'it' when 3 then 'en-AU' else 'PT' end")
    tracks = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("video_id"), code.alias("language_code"), (F.col("s_suppkey") % 2 == 0).alias("is_generated"))
    return tables.pick_caption(tracks).select("video_id", F.concat("language_code", F.lit("/"), F.col("is_generated").cast("string")).alias("track"))


@query("select conv_id, row_number() over (partition by conv_id order by turn // 3, turn, role, text)::int as video_index, sha256(text) as title_sha from conversations where role <> 'system'")
def s3_playlist_items(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") != "system", F.col("role")).alias("video_id"), F.col("text").alias("title"))
    item = F.struct("turn", F.col("video_id").alias("role"), F.col("title").alias("text"), "video_id", "title")
    pages = rows.groupBy("conv_id", F.floor(F.col("turn") / 3).alias("page_no")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return tables.playlist_items(pages, "conv_id").select("conv_id", "video_index", F.sha2("title", 256).alias("title_sha"))


@query("select p_partkey, coalesce(case when p_size > 25 then 'high' end, case when p_size > 10 then 'medium' end, '') as thumbnail from part")
def s5_thumbnails(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", tables.thumbnail(F.when(size > 25, "high"), F.when(size > 10, "medium")).alias("thumbnail"))


@query("select event_id, json_extract_string(case when event_id % 4 = 0 then null else props end, '$.k')::bigint as k, case event_id % 4 when 0 then 'invalid' end as rejected from events")
def s9_payloads(spark, sf_dir):
    line = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("event_id", tables.parsed_payload(line, "k bigint").alias("p"), tables.payload_error(line).alias("rejected"))
    return rows.select("event_id", "p.k", "rejected")


@query("select o_orderkey, o_orderpriority from orders where o_orderstatus = 'F' and o_totalprice > 100000")
def s1_p1_filtered_scan(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_totalprice > 100000").select("o_orderkey", "o_orderpriority")


@query("select event_id, event_type from events where event_type not in ('purchase', 'error')")
def g23_delete_by_set(spark, sf_dir):
    return table(spark, sf_dir, "events").where(~F.col("event_type").isin("purchase", "error")).select("event_id", "event_type")


@query("select item_id, sha1('[\"' || item_id || '\"]') as cache_key, length(text)::bigint as n, item_id < 10 as cached from benchmark")
def k11_memoised(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    key = F.sha1(F.to_json(F.array(F.col("item_id").cast("string"))))
    memo = items.where("item_id < 10").select(key.alias("cache_key"), F.length("text").cast("long").alias("n"), F.lit(True).alias("cached"))
    rows, _ = tables.memoised(items, memo, ["item_id"], lambda x: x.withColumns({"n": F.length("text").cast("long"), "cached": F.lit(False)}))
    return rows.select("item_id", "cache_key", "n", "cached")


@query("select custkey, status, n::bigint as n from (select o_custkey % 7 as custkey, o_orderstatus as status, count(*) as n from orders group by all)")
def a25_outcome_counters(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 7).alias("custkey"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("select event_id from (select event_id from events order by md5(event_id::varchar), event_id limit 40)")
def o5_seeded_sample(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.md5(F.col("event_id").cast("string")), "event_id").limit(40).select("event_id")
