"""Caption outcomes, retries and stages as column rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsieve.functions import lexicons as L
from quillsieve.functions.text import blank_to_null


def _has_any(text: Column, marks: tuple[str, ...]) -> Column:
    low = F.coalesce(F.lower(text), F.lit(""))
    out = F.lit(False)
    for m in marks:
        out = out | low.contains(m)
    return out


def is_rate_limit_message(message: Column) -> Column:
    return _has_any(message, L.RATE_LIMIT_MARKS)


def is_rate_limited(error_type: Column, error: Column) -> Column:
    kind = F.coalesce(error_type, F.lit(""))
    return (kind == "rate_limited") | ((kind == "execution_error") & _has_any(error, ("timeout",))) | _has_any(error, L.BLOCK_MARKS)


def caption_message(error_type: Column, error: Column) -> Column:
    out = F.when(is_rate_limited(error_type, error), L.RATE_LIMITED)
    for kind, message in L.CAPTION_MESSAGES.items():
        out = out.when(error_type == kind, message)
    return out.otherwise(L.CAPTION_FAILED)


def classify_error(error_class: Column, message: Column) -> Column:
    """The error type of an exception by its class, else by its message."""
    return (
        F.when(error_class.isin("IpBlocked", "RequestBlocked", "Timeout"), "rate_limited")
        .when(error_class.isin("NoTranscriptFound", "TranscriptsDisabled"), "no_transcript")
        .when(error_class.isin("VideoUnavailable", "VideoUnplayable", "AgeRestricted"), "video_unavailable")
        .when(error_class == "InvalidVideoId", "invalid_video_id")
        .when(F.lower(message).contains("timeout") | message.contains("429"), "rate_limited")
        .otherwise("api_error")
    )


def single_outcome(success: Column, raw_text: Column, word_count: Column, language: Column, error_type: Column, error: Column) -> Column:
    """One video: a blank text is a failure, no words count as unknown, the language is English unless told."""
    done = F.coalesce(success, F.lit(False)) & blank_to_null(raw_text).isNotNull()
    return F.struct(
        F.when(done, "COMPLETED").otherwise("ERROR").alias("status"),
        F.when(done, raw_text).alias("content"),
        F.when(~done, caption_message(error_type, error)).alias("error_message"),
        F.when(done & (word_count > 0), word_count).alias("word_count"),
        F.when(done, F.coalesce(F.nullif(language, F.lit("")), F.lit("en"))).otherwise("en").alias("language"),
    )


def playlist_outcome(success: Column, raw_text: Column, word_count: Column, language: Column, error_type: Column, error: Column) -> Column:
    """A playlist's video: only an empty text is a failure, a blank one is not; no words count as 0."""
    done = F.coalesce(success & (raw_text != ""), F.lit(False))
    limited = is_rate_limited(error_type, error)
    return F.struct(
        F.when(done, "completed").otherwise("failed").alias("kind"),
        F.when(done, raw_text).alias("content"),
        F.when(done, F.coalesce(word_count, F.lit(0))).alias("word_count"),
        F.when(done, language).alias("language"),
        F.when(~done, caption_message(error_type, error)).alias("error_message"),
        (~done & limited).alias("rate_limited"),
    )


def valid_video_id(video: Column) -> Column:
    return F.coalesce(F.length(video) >= 8, F.lit(False))


def single_retry(status: Column, playlist_processing: Column) -> Column:
    rejected = F.when(status != "ERROR", L.NOT_AN_ERROR).when(playlist_processing, L.STILL_PROCESSING)
    return F.struct(F.when(rejected.isNull(), "started").otherwise("rejected").alias("outcome"), rejected.alias("message"))


def batch_retry(queried: Column) -> Column:
    started = queried > 0
    return F.struct(
        F.when(started, "started").otherwise("rejected").alias("outcome"),
        F.when(~started, L.NOTHING_TO_RETRY).alias("message"),
        F.when(started, queried).alias("retried"),
    )


def pipeline_step(has_text: Column, processed: Column, deduplicated: Column, curated: Column) -> Column:
    """The first stage that is missing, or null when all are there."""
    return (
        F.when(~has_text, "extracted").when(~processed, "processed").when(~deduplicated, "deduplicated").when(~curated, "curated")
    )


def furthest_stage(curation_score: Column, processed: Column) -> Column:
    return F.when(curation_score.isNotNull(), "curated").when(processed, "processed").otherwise("raw")


STAGE_RANK = {"raw": 0, "processed": 1, "curated": 2}  # fixed values


def quality_tone(score: Column) -> Column:
    return F.when(score >= 0.75, "good").when(score >= 0.5, "fair").otherwise("poor")


def skip_batch_curation(dedup_status: Column, curation: Column) -> Column:
    return dedup_status.isin("pending", "duplicate") | curation.isNotNull()


def single_curation_block(dedup_status: Column, text: Column) -> Column:
    """Why one text cannot be curated, or null: pending blocks, a duplicate does not, blank does."""
    return F.when(dedup_status == "pending", "pending").when(blank_to_null(text).isNull(), "blank")


def judge_runs(runs: Column) -> Column:
    x = runs.try_cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.greatest(F.lit(1), F.least(F.lit(5), F.floor(x)))).otherwise(1).cast("int")


def curation_timeout_ms(chars: Column, runs: Column) -> Column:
    """120 s and 90 s for each of 1 to 10 chunks of 6,000 characters and each run, at most 900 s a run."""
    chunks = F.greatest(F.lit(1), F.least(F.lit(10), F.ceil(chars / 6000)))
    return F.least(120_000 + 90_000 * chunks * runs, 900_000 * runs).cast("long")


def curation_score(overall: Column) -> Column:
    return F.round(overall / 10, 4)
