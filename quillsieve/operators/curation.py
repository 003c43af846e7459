"""Judge scores: chunks, prompts, replies, runs and their aggregation."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsieve.functions import lexicons as L
from quillsieve.functions import text as T
from quillsieve.operators.calls import RateLimit, in_flight

PROMPT_VERSION = "curation-1"


class Judge(Protocol):
    """Answers a prompt; ``provider`` and ``model`` name it."""

    provider: str
    model: str

    def __call__(self, prompt: str, run: int) -> str: ...


class HashJudge:
    """A deterministic stand-in: scores follow from a hash of the prompt's characters and the run."""

    provider, model = "stub", "hash-judge"

    def __call__(self, prompt: str, run: int) -> str:
        seed = sum(map(ord, prompt)) + 7 * run
        return json.dumps({c: (seed * (k + 3)) % 101 / 10 for k, c in enumerate(L.CRITERIA)} | {"rationale": f"run {run}"})


def split_chunks(text: Column | str, most: int = 6000) -> Column:
    """Whole sentences packed into chunks of up to ``most`` characters; a longer sentence is cut."""
    t = T.blank_to_null(text)
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def pack(state: Column, sentence: Column) -> Column:
        joined = F.when(state["open"] == "", sentence).otherwise(F.concat(state["open"], F.lit(" "), sentence))
        closed = F.when(state["open"] == "", state["done"]).otherwise(F.array_append(state["done"], state["open"]))
        cuts = F.transform(F.sequence(F.lit(1), F.length(sentence), F.lit(most)), lambda k: F.trim(F.substring(sentence, k, F.lit(most))))
        long_ = F.length(sentence) > most
        return (
            F.when(F.length(joined) <= most, F.struct(state["done"].alias("done"), joined.alias("open")))
            .when(long_, F.struct(F.concat(closed, F.filter(cuts, lambda c: c != "")).alias("done"), F.lit("").alias("open")))
            .otherwise(F.struct(closed.alias("done"), sentence.alias("open")))
        )

    ended = lambda packed: F.when(packed["open"] == "", packed["done"]).otherwise(F.array_append(packed["done"], packed["open"]))
    chunks = lambda t: T.once(F.aggregate(T.split_sentences(t), empty, pack), ended)
    return T.once(t, lambda t: F.when(t.isNull(), F.array().cast("array<string>")).when(F.length(t) <= most, F.array(t)).otherwise(chunks(t)))


def select_chunks(chunks: Column | str, most: int = 10) -> Column:
    """At most ``most`` chunks at even distances, the first and the last among them."""
    c = F.col(chunks) if isinstance(chunks, str) else chunks
    if most <= 1:
        return F.slice(c, 1, 1)

    def chosen(c: Column) -> Column:
        places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda s: F.bround(s * (F.size(c) - 1) / (most - 1)).cast("int")))
        return F.when(F.size(c) <= most, c).otherwise(F.transform(places, lambda k: F.get(c, k)))

    # the chunks are bound: a lambda that names an expression works it out for each place
    return T.once(c, chosen)


def parse_reply(raw: Column | str) -> Column:
    """Three scores, their mean, the rationale and its parts by criterion; null if a score is missing or no number."""
    value = lambda body, name: F.get_json_object(body, f"$.{name}")

    def fields(body: Column) -> Column:
        return F.struct(
            *[T.score(value(body, c)).alias(c) for c in L.CRITERIA],
            value(body, "rationale").alias("told"),
            *[F.coalesce(F.trim(value(body, f"rationale.{c}")), F.lit("")).alias(f"told_{c}") for c in L.CRITERIA],
        )

    def result(f: Column) -> Column:
        parts = F.map_filter(F.create_map(*[x for c in L.CRITERIA for x in (F.lit(c), f[f"told_{c}"])]), lambda _, v: v != "")
        is_map = F.coalesce(f["told"].startswith("{"), F.lit(False))
        whole = F.array_join(F.filter(F.array(*[f[f"told_{c}"] for c in L.CRITERIA]), lambda x: x != ""), " ")
        good = F.lit(True)
        for c in L.CRITERIA:
            good = good & f[c].isNotNull()
        found = F.struct(
            *[f[c].alias(c) for c in L.CRITERIA],
            F.round(sum((f[c] for c in L.CRITERIA), F.lit(0.0)) / 3, 2).alias("overall"),
            F.when(is_map, whole).otherwise(F.coalesce(F.trim(f["told"]), F.lit(""))).alias("rationale"),
            F.when(is_map, parts).otherwise(F.create_map().cast("map<string,string>")).alias("criteria_rationale"),
        )
        return F.when(good, found)

    # the object and its fields are bound, so a reply is parsed once for each field, not for each mention
    return T.once(T.once(T.json_object(raw), fields), result)


def ask(
    prompts: DataFrame, judges: list[Judge], prompt: str = "prompt", run: str = "run", window: int = 6, attempts: int = 1, rate: RateLimit | None = None
) -> DataFrame:
    """``prompts`` with ``raw``, ``provider`` and ``model``: the first judge's answer, the next one's where it fails, null where all do.

    A task has ``window`` prompts in flight and keeps the order of its rows; a prompt that every judge fails is tried
    ``attempts`` times; ``rate`` bounds the calls of all tasks.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in prompts.dtypes) + ", raw string, provider string, model string"
    limit = rate.shared(prompts) if rate else None

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = zip(batch[prompt], batch[run], strict=True)
            rows = [r or (None, None, None) for r in in_flight(asked, lambda pr: _first_answer(judges, *pr), window, attempts, limit)]
            yield batch.assign(**{k: [r[i] for r in rows] for i, k in enumerate(("raw", "provider", "model"))})

    return prompts.mapInPandas(answered, schema)


def _first_answer(judges: list[Judge], prompt: str, run: int) -> tuple[str, str, str]:
    for judge in judges:
        try:
            return judge(prompt, int(run)), judge.provider, judge.model
        except Exception:  # noqa: BLE001, S112  any provider error moves on to the next one
            continue
    raise RuntimeError("every judge failed")


def aggregate_runs(parsed: DataFrame, keys: list[str], run: str = "run") -> DataFrame:
    """One row a chunk: rounded means and population deviations, the first run's rationale, the last one's provider."""
    return (
        parsed.groupBy(*keys)
        .agg(
            *[F.round(F.avg(c), 2).alias(c) for c in L.CRITERIA],
            *[F.round(F.stddev_pop(c), 2).alias(f"{c}_std") for c in L.CRITERIA],
            F.count("*").alias("runs"),
            F.min_by("rationale", run).alias("rationale"),
            F.min_by("criteria_rationale", run).alias("criteria_rationale"),
            F.max_by("provider", run).alias("provider"),
            F.max_by("model", run).alias("model"),
        )
        .withColumn("overall", F.round((F.col("coherence") + F.col("richness") + F.col("factuality")) / 3, 2))
    )


def aggregate_chunks(chunks: DataFrame, key: str, chunk: str = "chunk_idx") -> DataFrame:
    """One row a document: means of the chunks, the overall score of the rounded means, the first three rationales."""
    rationale = F.nullif(F.trim("rationale"), F.lit(""))
    told = F.slice(F.array_sort(F.collect_list(F.when(rationale.isNotNull(), F.struct(F.col(chunk).alias("i"), rationale.alias("r"))))), 1, 3)
    by_criterion = [
        F.min_by(F.element_at("criteria_rationale", c), F.when(F.element_at("criteria_rationale", c) != "", F.col(chunk))).alias(f"{c}_rationale")
        for c in L.CRITERIA
    ]
    return (
        chunks.groupBy(key)
        .agg(
            *[F.round(F.avg(c), 2).alias(c) for c in L.CRITERIA],
            *[F.round(F.avg(F.coalesce(f"{c}_std", F.lit(0.0))), 2).alias(f"{c}_std") for c in L.CRITERIA],
            *by_criterion,
            F.array_join(F.transform(told, lambda s: s["r"]), " ").alias("rationale"),
            F.max("runs").alias("runs"),
            F.max_by("provider", chunk).alias("provider"),
            F.max_by("model", chunk).alias("model"),
            F.count("*").alias("chunk_count"),
        )
        .withColumn("overall", F.round((F.col("coherence") + F.col("richness") + F.col("factuality")) / 3, 2))
        .withColumn("prompt_version", F.lit(PROMPT_VERSION))
    )


def prompts(docs: DataFrame, id_col: str, text_col: str, runs: int = 1, title: str | None = None, language: str | None = None, most_chars: int = 6000, most_chunks: int = 10) -> DataFrame:
    """A row for each document's selected chunk and run, with the prompt."""
    none = F.lit(None).cast("string")
    chosen = docs.withColumn("_chunks", select_chunks(split_chunks(text_col, most_chars), most_chunks)).withColumn("_n", F.size("_chunks"))
    rows = chosen.select(id_col, *[c for c in (title, language) if c], "_n", F.posexplode("_chunks").alias("chunk_idx", "chunk"))
    prompt = T.user_prompt(F.col(title) if title else none, F.col(language) if language else none, F.col("chunk_idx") + 1, F.col("_n"), F.col("chunk"))
    return rows.select(id_col, "chunk_idx", prompt.alias("prompt"), F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))


def curate(docs: DataFrame, id_col: str, text_col: str, judges: list[Judge], runs: int = 1, **options) -> DataFrame:
    """Documents with text, judged chunk by chunk and run by run; failed runs are left out, a document without any has no row."""
    answered = ask(prompts(docs, id_col, text_col, runs, **options), judges)
    parsed = answered.withColumn("parsed", parse_reply("raw")).where("parsed is not null").select(id_col, "chunk_idx", "run", "provider", "model", "parsed.*")
    return aggregate_chunks(aggregate_runs(parsed.drop("overall"), [id_col, "chunk_idx"]), id_col)


def pairwise(rows: DataFrame, judge: Callable[[str, str], str], id_col: str = "id") -> DataFrame:
    """Blind verdicts of (id, raw, processed) in both orders: a winner that depends on the order is a tie.

    The judge gets version A and B and names one; unknown answers and errors are ties.
    """
    a, b = T.excerpt_pair("raw", "processed")
    pairs = rows.select(id_col, T.strip_tags(a, ("version_a", "version_b")).alias("raw"), T.strip_tags(b, ("version_a", "version_b")).alias("processed"))

    @F.pandas_udf("string")
    def winner(first: pd.Series, second: pd.Series) -> pd.Series:
        def one(x: str, y: str) -> str | None:
            try:
                return judge(x, y)
            except Exception:  # noqa: BLE001  a judge that fails has no winner
                return None

        return pd.Series([one(x, y) for x, y in zip(first, second, strict=True)], dtype="object")

    asked = pairs.select(id_col, T.normalize_winner(winner("raw", "processed")).alias("one"), T.normalize_winner(winner("processed", "raw")).alias("two"))
    named = lambda c, a_is, b_is: F.when(F.col(c) == "A", a_is).when(F.col(c) == "B", b_is).otherwise("tie")
    outcome, same = T.resolve_swapped(named("one", "raw", "processed"), named("two", "processed", "raw"))
    return asked.select(id_col, outcome.alias("outcome"), same.alias("position_consistent"))
