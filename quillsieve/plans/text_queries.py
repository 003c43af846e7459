"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillsieve.functions import lexicons as L
from quillsieve.functions import text as T
from quillsieve.plans.registry import Registry, documents, table

query = Registry()

WORDS_SQL = f"regexp_extract_all(text, '{L.WORD.replace(chr(39), chr(39) * 2)}')"
PARTS_SQL = f"regexp_extract_all(text, '{L.WORD_OR_GAP.replace(chr(39), chr(39) * 2)}')"
FILLERS_SQL = "case " + " ".join(
    f"when lang = '{k}' then [{', '.join(repr(w) for w in v)}]" for k, v in L.FILLERS.items()
) + f" else [{', '.join(repr(w) for w in L.FILLERS['en'])}] end"
SPACE_SQL = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def digest(text):
    return F.sha2(text.cast("binary"), 256)


@query(f"select doc_id, len(w)::bigint as n_words, sha256(array_to_string(w, chr(10))) as words_sha from (select doc_id, {WORDS_SQL} as w from documents)")
def t1_tokenize_words(spark, sf_dir):
    w = T.words("text")
    return documents(spark, sf_dir).select("doc_id", F.size(w).cast("long").alias("n_words"), digest(F.array_join(w, "\n")).alias("words_sha"))


@query(f"select doc_id, length(n)::bigint as n_chars, sha256(n) as exact_hash from (select doc_id, array_to_string(list_transform({WORDS_SQL}, lambda x: lower(x)), ' ') as n from documents)")
def t2_t31_normalized_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.length(T.normalized_text("text")).cast("long").alias("n_chars"), T.exact_hash("text").alias("exact_hash"))


@query(f"select doc_id, sha256(array_to_string(list_transform({WORDS_SQL}, lambda x: strip_accents(lower(x))), ' ')) as keys_sha from documents")
def t3_t4_folded_words(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", digest(F.array_join(T.word_keys("text"), " ")).alias("keys_sha"))


@query("""
    with codes as (select unnest([lang, upper(lang) || '_BR', ' ' || lang || '-XX ', '', null]) as code from documents)
    select code, coalesce(nullif(split_part(replace(lower(trim(code)), '_', '-'), '-', 1), ''), 'en') as language, count(*)::bigint as n
    from codes group by code
""")
def t5_normalize_language(spark, sf_dir):
    codes = F.array("lang", F.concat(F.upper("lang"), F.lit("_BR")), F.concat(F.lit(" "), "lang", F.lit("-XX ")), F.lit(""), F.lit(None))
    rows = table(spark, sf_dir, "documents").select(F.explode(codes).alias("code"))
    return rows.groupBy("code").agg(F.count("*").alias("n")).withColumn("language", T.normalize_language("code"))


def _hits_sql(name: str) -> str:
    return f"len(list_filter(bare, lambda w: list_contains([{', '.join(repr(w) for w in T.FUNCTION_WORDS[name].split())}], w)))"


#: (doc_id, text, lang) with the language that the function words of ``text`` in the relation ``src`` (doc_id, lang, text) tell.
DETECTED_SQL = rf"""
    d0 as (select doc_id, lang, text, list_filter(regexp_split_to_array(lower(text), '{SPACE_SQL}+'), lambda w: w <> '') as tokens from src),
    d1 as (select *, list_transform(tokens, lambda w: regexp_replace(w, '^[^\p{{L}}]+|[^\p{{L}}]+$', '', 'g')) as bare from d0),
    d2 as (select doc_id, lang, len(tokens) as n, unnest([{', '.join(f"{{'n': {_hits_sql(k)}, 'k': {i}, 'l': '{k}'}}" for i, k in enumerate(T.FUNCTION_WORDS))}]) as s from d1),
    d3 as (select doc_id, any_value(lang) as own, any_value(n) as n, max(s.n) as hits, arg_max(s.l, s.n * 100 + (s.l = lang)::int * 10 - s.k) as l from d2 group by doc_id),
    detected as (select doc_id, text, case when n < 5 or hits = 0 then own else l end as lang from d0 join d3 using (doc_id))
"""


@query(f"with src as (select doc_id, lang, text from documents), {DETECTED_SQL} select doc_id, lang as language from detected")
def t6_detect_language(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.function_word_language("text", T.normalize_language("lang")).alias("language"))


_STAMPED = "text || ' [' || (doc_id % 60) || ':15] (1:' || (doc_id % 50 + 10) || ':07,5) 12:30 x 1:2 00:' || (doc_id % 50 + 10) || '.250 end'"


def _chain(text: str) -> tuple[str, str]:
    count, t = "0", text
    for p in L.TIMESTAMPS:
        count += f" + len(regexp_extract_all({t}, '{p}'))"
        t = f"regexp_replace({t}, '{p}', ' ', 'g')"
    return count, t


@query(f"select doc_id, ({_chain('text')[0]})::bigint as removed, sha256({_chain('text')[1]}) as text_sha from (select doc_id, {_STAMPED} as text from documents)")
def t7_remove_timestamps(spark, sf_dir):
    n, t = T.timestamp_count_and_text(F.expr(_STAMPED))
    return documents(spark, sf_dir).select("doc_id", n.cast("long").alias("removed"), digest(t).alias("text_sha"))


_NOTED = "text || ' [music [loud]] a ♪la la♪ b (risadas) c {Música tocando} d (como eu disse) (2020) ♪ (' || lang || ' laughs) ok'"
_FOLDED = f"list_transform(regexp_extract_all(p[2:-2], '{L.WORD.replace(chr(39), chr(39) * 2)}'), lambda x: strip_accents(lower(x)))"
_SOUND = f"(list_contains([{', '.join(map(repr, L.NONVERBAL_EXACT))}], w) or regexp_matches(w, '^({'|'.join(L.NONVERBAL_STEMS)})'))"


def _unbracketed(t: str) -> str:
    for _ in range(8):
        t = rf"regexp_replace({t}, '\[[^\[\]]*\]', ' ', 'g')"
    return f"replace(regexp_replace({t}, '♪[^♪]*♪', ' ', 'g'), '♪', ' ')"


@query(rf"""
    with cut as (select doc_id, unnest(parts) as p, generate_subscripts(parts, 1) as k from (
        select doc_id, regexp_extract_all({_unbracketed('text')}, '\([^()]*\)|\{{[^{{}}]*\}}|[^(){{}}]+|[(){{}}]') as parts from (select doc_id, {_NOTED} as text from documents))),
    folded as (select doc_id, k, p, length(p) > 2 and regexp_matches(p, '^[({{]') and not regexp_matches(p, '\p{{Nd}}') as maybe, {_FOLDED} as keys from cut),
    judged as (select doc_id, k, case when maybe and len(keys) between 1 and 6
        and len(list_filter(keys, lambda w: {_SOUND})) > 0
        and len(list_filter(keys, lambda w: {_SOUND} or list_contains([{', '.join(map(repr, L.STAGE_MODIFIERS))}], w))) = len(keys)
        then ' ' else p end as p from folded)
    select doc_id, sha256(string_agg(p, '' order by k)) as text_sha from judged group by doc_id
""")
def t8_t9_remove_nonverbal(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", digest(T.remove_nonverbal(F.expr(_NOTED))).alias("text_sha"))


_SPOKEN = "'Uh, euh ' || replace(text, ' ', ' hm ') || ' äh-uh um'"


@query(f"""
    with t as (select doc_id, lang, {_SPOKEN} as text, {FILLERS_SQL} as listed from documents)
    select doc_id, len(list_filter({WORDS_SQL}, lambda x: list_contains(listed, lower(x))))::bigint as fillers,
      sha256(array_to_string(list_filter({PARTS_SQL}, lambda x: not list_contains(listed, lower(x))), '')) as text_sha from t
""")
def t10_t11_t12_fillers(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "lang", F.expr(_SPOKEN).alias("text")).withColumn("w", T.words("text"))
    return rows.select("doc_id", T.filler_count("w", "lang").cast("long").alias("fillers"), digest(T.remove_fillers("text", "lang")).alias("text_sha"))


@query(rf"""
    with s as (select doc_id, text, regexp_replace(regexp_replace(text, '{SPACE_SQL}+', ' ', 'g'), '^ | $', '', 'g') as spaced from documents),
    k as (select doc_id, unnest(p) as w, generate_subscripts(p, 1)::bigint as i from (select doc_id, string_split(spaced, ' ') as p from s)),
    e as (select *, regexp_matches(w, '[.!?]["''”’)\]]*$') as c1, lower(w) = lead(lower(w), 1) over d as e1, lower(w) = lead(lower(w), 2) over d as e2, lower(w) = lead(lower(w), 3) over d as e3
      from k window d as (partition by doc_id order by i)),
    r as (select doc_id, i, c1, c1 or coalesce(lead(c1, 1) over d, true) as c2, c1 or coalesce(lead(c1, 1) over d, true) or coalesce(lead(c1, 2) over d, true) as c3,
      (min(case when not coalesce(e1, false) then i end) over f - i) as r1, (min(case when not coalesce(e2, false) then i end) over f - i) // 2 as r2, (min(case when not coalesce(e3, false) then i end) over f - i) // 3 as r3
      from e window d as (partition by doc_id order by i), f as (partition by doc_id order by i rows between current row and unbounded following)),
    n as (select doc_id, i, case when r3 > 0 and not c3 then 3 when r2 > 0 and not c2 then 2 when r1 > 0 and not c1 then 1 else 0 end as n, r1, r2, r3 from r),
    b as (select doc_id, {{'i': i, 'own': i + n, 'stop': i + n * (1 + case n when 3 then r3 when 2 then r2 else r1 end), 'gone': []::bigint[]}} as b from n where n > 0),
    g as (select doc_id, list_reduce(list(b order by b.i), lambda x, y: case when y.i < x.stop then x else {{'i': y.i, 'own': y.own, 'stop': y.stop, 'gone': list_concat(x.gone, range(y.own, y.stop))}} end,
      {{'i': 0::bigint, 'own': 0::bigint, 'stop': 0::bigint, 'gone': []::bigint[]}}) as g from b group by doc_id),
    o as (select doc_id, unnest(g.gone) as i from g),
    f as (select doc_id, string_agg(w, ' ' order by i) as folded, count(*) as kept from k anti join o using (doc_id, i) group by doc_id),
    a as (select doc_id, count(*) as tokens from k group by doc_id)
    select doc_id, (tokens - kept)::bigint as removed, sha256(case when spaced = '' then text else folded end) as text_sha from s join f using (doc_id) join a using (doc_id)
""")
def t13_collapse_repetitions(spark, sf_dir):
    text, removed = T.collapse_repetitions("text")
    return documents(spark, sf_dir).select("doc_id", removed.cast("long").alias("removed"), digest(text).alias("text_sha"))


_COMMAS = "replace(text, '. ', ' ,, . , ') || ', 3,5 ,x , ,y ,'"


@query(rf"""
    with t as (select doc_id, {_COMMAS} as raw from documents),
    cleaned as (select doc_id, raw, regexp_replace(regexp_replace(raw, ',(?:{SPACE_SQL}*,)+', ',', 'g'), ',{SPACE_SQL}*([.;:!?])', '\1', 'g') as t from t),
    parts as (select doc_id, raw, string_split(t, ',') as p from cleaned),
    glued as (select doc_id, raw, array_to_string(list_transform(p, lambda x, i: case when i = 1 then x
        when regexp_matches(p[i - 1], '[\p{{L}}\p{{N}}]{SPACE_SQL}*$') and regexp_matches(x, '^{SPACE_SQL}*[\p{{L}}\p{{N}}]') then ',' || x else x end), '') as t from parts)
    select doc_id, (len(raw) - len(replace(raw, ',', '')) - len(t) + len(replace(t, ',', '')))::bigint as residual, sha256(t) as text_sha from glued
""")
def t14_t15_t16_orphan_commas(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.expr(_COMMAS).alias("text"))
    return rows.select("doc_id", T.residual_commas("text").cast("long").alias("residual"), digest(T.strip_orphan_commas("text")).alias("text_sha"))


_STEPS_SQL = (
    (r"\.{2,}", "..."),
    (r"[ \t]+", " "),
    (rf"([.!?]){SPACE_SQL}+[.!?]+({SPACE_SQL}|$)", r"\1\2"),
    (r"\n{3,}", "\n\n"),
    (rf"{SPACE_SQL}+([,.;:!?])", r"\1"),
    (rf"([.!?])([^\d{SPACE_SQL[1:-1]}])", r"\1 \2"),
    (rf"^{SPACE_SQL}+|{SPACE_SQL}+$", ""),
    (rf"([.!?]+){SPACE_SQL}+", "\x01\\1\x01"),
)


def _steps_sql(text: str) -> str:
    for pattern, new in _STEPS_SQL:
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


@query(rf"""
    with t as (select doc_id, string_split({_steps_sql("replace(text, chr(160), ' ')")}, chr(1)) as p from documents),
    c as (select doc_id, list_filter(list_transform(list_transform(p, lambda x, i: case when i % 2 = 1 then regexp_replace(x, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g') else x end),
      lambda x, i: case when i % 2 = 1 then upper(x[1]) || x[2:] else x end), lambda x: x <> '') as p from t),
    g as (select doc_id, array_to_string(list_transform(p, lambda x, i: case when i = 1 or regexp_full_match(x, '[.!?]+') then x else ' ' || x end), '') as t from c)
    select doc_id, sha256(case when t = '' or regexp_matches(t, '[.!?]$') then t else t || '.' end) as text_sha from g
""")
def t17_normalize_sentences(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", digest(T.normalize_sentences("text")).alias("text_sha"))


_SPLIT_SQL = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){SPACE_SQL}+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^{SPACE_SQL}+|{SPACE_SQL}+$', '', 'g')), lambda x: x <> '')"


@query(f"select doc_id, idx::int as idx, sha256(s) as sentence_sha from (select doc_id, unnest(p) as s, generate_subscripts(p, 1) - 1 as idx from (select doc_id, {_SPLIT_SQL} as p from documents))")
def t19_t20_sentence_segments(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(T.split_sentences("text")).alias("idx", "s"))
    return rows.select("doc_id", "idx", digest(F.col("s")).alias("sentence_sha"))


_WORD_SQL = L.WORD.replace("'", "''")


@query(f"""
    with s as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: len(regexp_extract_all(x, '{_WORD_SQL}'))), lambda n: n > 0) as sizes, {WORDS_SQL} as w from documents)
    select doc_id, len(sizes)::bigint as sentences, coalesce(list_max(sizes), 0)::bigint as longest,
      coalesce(list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '{L.VOWELS}'))))), 0)::bigint as syllables from s
""")
def t21_t22_sentences_and_syllables(spark, sf_dir):
    sizes = F.transform(T.sentence_words("text"), F.size)
    syllables = F.aggregate(T.words("text"), F.lit(0).cast("long"), lambda a, x: a + T.syllables(x))
    return documents(spark, sf_dir).select(
        "doc_id", F.size(sizes).cast("long").alias("sentences"), F.coalesce(F.array_max(sizes), F.lit(0)).cast("long").alias("longest"), syllables.alias("syllables")
    )


_LINKS = "case page_id % 6 when 0 then 'https://www.youtube.com/watch?v=' || substr(md5(url), 1, 11) when 1 then 'see https://youtu.be/' || substr(md5(url), 1, 11) || '?t=5 and https://youtube.com/v/abc#x' when 2 then 'https://youtube.com/playlist?list=PL' || page_id when 3 then 'https://www.youtube.com/watch?v=abc&list=PL' || page_id when 4 then 'https://youtube.com/@name/videos' else url end"


def _pick(p: str, of: str = "t") -> str:
    return f"nullif(regexp_extract({of}, '{p}', 1), '')"


@query(f"""
    with r as (select page_id, {_LINKS} as t from pages), u as (select page_id, t, regexp_extract_all(t, '{T._LINK}') as urls from r)
    select page_id, array_to_string(urls, ' ') as urls, coalesce({_pick(T._VIDEO[0])}, {_pick(T._VIDEO[1])}) as video_id, {_pick(T._PLAYLIST)} as playlist_id,
      case when len(urls) = 0 then null when len(list_filter(urls, lambda x: contains(x, 'playlist'))) > 0 then 'playlist'
        when len(list_filter(urls, lambda x: regexp_matches(x, '{T._CHANNEL}'))) > 0 then 'channel' when len(urls) = 1 then 'video' else 'mixed' end as kind from u
""")
def t23_p17_links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(_LINKS).alias("t")).withColumn("urls", T.detect_urls("t"))
    return rows.select("page_id", F.array_join("urls", " ").alias("urls"), T.video_id("t").alias("video_id"), T.playlist_id("t").alias("playlist_id"), T.url_kind("urls").alias("kind"))


_ISO = "case page_id % 4 when 0 then 'PT' || (page_id % 9) || 'H' || (page_id % 60) || 'M' || (page_id % 47) || 'S' when 1 then 'PT' || page_id || 'M' when 2 then 'P1D' else 'PT' || (page_id % 200) || 'S' end"


def _duration(k: int) -> str:
    return f"coalesce(nullif(regexp_extract(d, '{T._DURATION}', {k}), '')::bigint, 0)"


@query(f"""
    with r as (select page_id, {_ISO} as d from pages), s as (select page_id, {_duration(1)} * 3600 + {_duration(2)} * 60 + {_duration(3)} as s from r)
    select page_id, s as seconds, case when s <= 0 then '—' when s >= 3600 then (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' when s >= 60 and s % 60 > 0 then (s // 60) || 'm ' || (s % 60) || 's'
      when s >= 60 then (s // 60) || 'm' else s || 's' end as shown from s
""")
def t24_t25_durations(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", T.iso_duration_seconds(F.expr(_ISO)).alias("seconds"))
    return rows.select("page_id", "seconds", T.format_duration("seconds").alias("shown"))


_MAIL = "case c_custkey % 4 when 0 then replace(lower(c_name), '#', '.') || '@x.org' when 1 then 'ana_maria_' || c_custkey || '@x.org' when 2 then 'jOÃO-silva@x' else lower(c_mktsegment) || '@y' end"
_CAPITAL = "upper(x[1]) || lower(x[2:])"


@query(f"""
    with m as (select c_custkey, split_part({_MAIL}, '@', 1) as l from customer)
    select c_custkey, array_to_string(list_transform(list_filter(string_split(l, case when contains(l, '.') then '.' when contains(l, '_') then '_' when contains(l, '-') then '-' else chr(1) end), lambda x: x <> ''), lambda x: {_CAPITAL}), ' ') as name from m
""")
def t26_display_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.name_from_email(F.expr(_MAIL)).alias("name"))


@query("""
    select conv_id, array_to_string(list(turn || '. ' || role || chr(10) || trim(text) order by turn, role, text), chr(10)) as copied from conversations group by conv_id
""")
def t27_copy_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    item = F.concat(F.col("turn").cast("string"), F.lit(". "), "role", F.lit("\n"), F.trim("text"))
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text", item.alias("item"))))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["item"]), "\n").alias("copied"))


@query("""
    select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((extract(milliseconds from ts) % 1000)::bigint::varchar, 3, '0') || 'Z' as iso,
      ts < timestamp '2024-04-10' - interval 90 days as expired from events
""")
def t28_timestamps(spark, sf_dir):
    cutoff = F.lit("2024-04-10").cast("timestamp") - F.make_interval(days=F.lit(90))
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"), (F.col("ts") < cutoff).alias("expired"))


@query("select l_orderkey, l_linenumber, round(l_discount::double * 7.5, 4) as score4, floor(l_extendedprice::double + 0.5)::bigint as whole from lineitem")
def t29_rounding(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_discount").cast("double") * 7.5, 4).alias("score4"), F.floor(F.col("l_extendedprice").cast("double") + 0.5).cast("long").alias("whole")
    )


_REPLY = "case event_id % 3 when 0 then 'Sure: ' || props || ' done' when 1 then 'x' || chr(10) || '```json' || chr(10) || props || chr(10) || '``` {bad' else 'no json' end"


@query(f"select event_id, json_extract_string(j, '$.k')::bigint as k from (select event_id, case when event_id % 3 < 2 then props end as j from events)")
def t30_json_objects(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", T.json_object(F.expr(_REPLY)).alias("j"))
    return rows.select("event_id", F.get_json_object("j", "$.k").cast("long").alias("k"))


_LABEL = "case l_linenumber when 1 then 'Version A' when 2 then 'version_b' when 3 then ' B. ' when 4 then 'both' when 5 then null when 6 then '\"a\"!' else l_returnflag end"


@query(f"""
    with w as (select l_orderkey, l_linenumber, l_returnflag, trim(regexp_replace(lower(trim({_LABEL})), '^version[\\s_\\-]*', ''), ' .!"''') as t from lineitem),
    n as (select l_orderkey, l_linenumber, l_returnflag, case when t = 'a' then 'A' when t = 'b' then 'B' else 'tie' end as winner from w)
    select l_orderkey, l_linenumber, winner, case when winner = l_returnflag then winner else 'tie' end as outcome, winner = l_returnflag as consistent from n
""")
def t32_t33_winners(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", T.normalize_winner(F.expr(_LABEL)).alias("winner"))
    outcome, same = T.resolve_swapped("winner", "l_returnflag")
    return rows.select("l_orderkey", "l_linenumber", "winner", outcome.alias("outcome"), same.alias("consistent"))


_TOKENS = rf"list_filter(regexp_split_to_array(x, '{SPACE_SQL}+'), lambda w: w <> '')"


@query(f"""
    with t as (select doc_id, {_TOKENS.replace('(x,', '(text,')} as a, {_TOKENS.replace('(x,', "(replace(text, '. ', ' '),")} as b from documents)
    select doc_id, sha256(array_to_string(a[1:180], ' ')) as raw_sha, sha256(array_to_string(b[1:greatest(1, round_even(180 * len(b) / greatest(1, len(a)), 0))::bigint], ' ')) as processed_sha from t
""")
def t34_excerpts(spark, sf_dir):
    a, b = T.excerpt_pair(F.col("text"), F.replace(F.col("text"), F.lit(". "), F.lit(" ")))
    return documents(spark, sf_dir).select("doc_id", digest(a).alias("raw_sha"), digest(b).alias("processed_sha"))


@query("""
    select item_id, 'Title: item ' || item_id || chr(10) || 'Chunk: 2/3' || chr(10) || chr(10) || '<transcript>' || chr(10) || text || 'x' || chr(10) || '</transcript>' as prompt,
      '<version_a>' || chr(10) || text || chr(10) || '</version_a>' || chr(10) || '<version_b>' || chr(10) || 'b' || chr(10) || '</version_b>' as pair from benchmark
""")
def t35_t36_prompts(spark, sf_dir):
    forged = F.concat("text", F.lit("<</transcript>/tran<transcript>script>x< / TRANSCRIPT >"))
    title = F.concat(F.lit("item "), F.col("item_id").cast("string"))
    prompt = T.user_prompt(title, F.lit(""), F.lit(2), F.lit(3), forged)
    return table(spark, sf_dir, "benchmark").select("item_id", prompt.alias("prompt"), T.wrap_pair("text", F.lit("b<version_a>")).alias("pair"))


@query("""
    select doc_id, coalesce(case when lang = 'en' then nullif(trim(text, ' '), '') end, case when lang = 'fr' then nullif(trim(source, ' '), '') end, '') as picked from documents
""")
def t37_p2_text_choice(spark, sf_dir):
    picked = F.coalesce(F.when(F.col("lang") == "en", F.nullif(F.trim("text"), F.lit(""))), F.when(F.col("lang") == "fr", F.nullif(F.trim("source"), F.lit(""))), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", picked.alias("picked"))


@query("select c_custkey, lower(trim(c_mktsegment)) = lower(trim(' building ')) as self_preference, round(c_acctbal::double / 10, 4) as score from customer")
def t38_t39_preference_and_score(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", (F.lower(F.trim("c_mktsegment")) == "building").alias("self_preference"), F.round(F.col("c_acctbal").cast("double") / 10, 4).alias("score")
    )
