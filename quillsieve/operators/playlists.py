"""Playlist queries: joins, summaries, progress, grouping, cancellation and resume plans, and row patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsieve.functions import lexicons as L
from quillsieve.operators.outcomes import STAGE_RANK, furthest_stage, is_rate_limit_message


def summarize(rows: DataFrame, key: str, cancelled: Column | None = None) -> DataFrame:
    """One row a playlist from (key, status, word_count): counts, words of completed rows, status and message.

    Processing rows come first; a playlist fails only if rows failed and none completed.
    """
    n = lambda s: F.count_if(F.col("status") == s)
    cancelled = F.lit(False) if cancelled is None else F.coalesce(F.bool_or(cancelled), F.lit(False))
    counted = rows.groupBy(key).agg(
        n("ERROR").alias("failed"), n("PROCESSING").alias("processing"), n("COMPLETED").alias("completed"),
        F.coalesce(F.sum(F.when(F.col("status") == "COMPLETED", F.col("word_count"))), F.lit(0)).cast("long").alias("total_word_count"),
        cancelled.alias("cancelled"),
    )
    busy = F.col("processing") > 0
    status = F.when(busy, "PROCESSING").when((F.col("failed") > 0) & (F.col("completed") == 0), "ERROR").otherwise("COMPLETED")
    message = (
        F.when(busy, F.lit(None).cast("string"))
        .when(F.col("cancelled"), L.RATE_LIMITED)
        .when(F.col("failed") > 0, F.concat(F.col("failed").cast("string"), F.lit(L.FAILED_SUFFIX)))
    )
    return counted.select(key, status.alias("status"), message.alias("error_message"), "total_word_count", "failed", "processing", "completed")


def progress(counts: DataFrame, video_count: str = "video_count") -> Column:
    """Percent of rows that ended, rounded half up; without videos 100 for completed playlists, else 0."""
    done = F.floor(100 * (F.col("completed") + F.col("failed")) / F.nullif(F.col(video_count), F.lit(0)) + 0.5)
    return F.coalesce(done, F.when(F.col("status") == "COMPLETED", 100).otherwise(0)).cast("long")


def panel_counts(rows: DataFrame) -> DataFrame:
    """Counters of (status, is_processed, deduplication_status, curation_score) and the mean quality, null if none."""
    return rows.agg(
        F.count_if("is_processed").alias("processed"),
        F.count_if(F.col("deduplication_status") != "pending").alias("deduplicated"),
        F.count_if(F.col("curation_score").isNotNull()).alias("curated"),
        F.count_if(F.col("deduplication_status") == "duplicate").alias("duplicates"),
        F.count_if(F.col("status") == "ERROR").alias("failed"),
        F.avg("quality_score").alias("average_quality"),
    )


def furthest_playlist_stage(rows: DataFrame, key: str) -> DataFrame:
    rank = F.lit(0)
    stage = furthest_stage(F.col("curation_score"), F.col("is_processed"))
    for name, k in STAGE_RANK.items():
        rank = F.when(stage == name, k).otherwise(rank)
    names = F.array(*[F.lit(n) for n in sorted(STAGE_RANK, key=STAGE_RANK.get)])
    return rows.groupBy(key).agg(F.max(rank).alias("r")).select(key, F.get(names, F.col("r")).alias("stage"))


def with_playlist(rows: DataFrame, playlists: DataFrame, key: str = "playlist_id") -> DataFrame:
    """Each row with its playlist's columns, null where it has none; Spark broadcasts the playlists if their size allows."""
    return rows.join(playlists, key, "left")


def with_members(playlists: DataFrame, rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Each playlist with its rows in order; a null position comes last."""
    pos = F.coalesce(F.col(order).cast("long"), F.lit(2**62)).alias("_pos")
    nested = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(pos, *fields))).alias("members"))
    members = F.transform("members", lambda m: F.struct(*[m[f].alias(f) for f in fields]))
    return playlists.join(nested, key, "left").withColumn("members", F.coalesce(members, F.array()))


def in_channel(rows: DataFrame, playlists: DataFrame, channel: str, key: str = "playlist_id") -> DataFrame:
    return rows.join(playlists.where(F.col("channel_id") == channel).select(key), key, "left_semi")


def group_jobs(rows: DataFrame, key: str, order: str, position: str, fields: list[str]) -> DataFrame:
    """Groups in the order of their first row; members by position, null counting as 0."""
    member = F.struct(F.coalesce(F.col(position), F.lit(0)).alias("_pos"), F.col(order).alias("_order"), *fields)
    grouped = rows.groupBy(key).agg(F.min(order).alias("first_row"), F.array_sort(F.collect_list(member)).alias("members"))
    return grouped.withColumn("members", F.transform("members", lambda m: F.struct(*[m[f].alias(f) for f in fields])))


def cancel_after_rate_limit(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows still processing after a rate-limited one of the same playlist become errors."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    hit = F.coalesce(F.max(F.col("rate_limited").cast("int")).over(before), F.lit(0)) == 1
    df = rows.withColumn("cancelled", hit & (F.col("status") == "PROCESSING"))
    return df.withColumns(
        {
            "status": F.when(F.col("cancelled"), "ERROR").otherwise(F.col("status")),
            "error_message": F.when(F.col("cancelled"), L.CANCELLED).otherwise(F.col("error_message")),
        }
    )


def resume_plan(rows: DataFrame, key: str) -> DataFrame:
    """Each interrupted row with its action: one rate-limited row cancels its whole playlist."""
    own = is_rate_limit_message(F.col("error_message"))
    any_ = F.max(own.cast("int")).over(Window.partitionBy(key)) == 1
    return rows.withColumns(
        {
            "action": F.when(any_, "cancel").otherwise("resume"),
            "message": F.when(any_ & own, L.RATE_LIMITED).when(any_, L.CANCELLED),
        }
    )


def newest(rows: DataFrame, by: str, n: int, tie: str) -> DataFrame:
    """The ``n`` newest rows, each with the count of all: the counts of tasks meet in one row, rows do not."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc_nulls_last(by), tie).limit(n).join(F.broadcast(total))


def patch(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with the non-null values of ``changes`` (key and some columns); unknown keys are ignored."""
    fields = [c for c in changes.columns if c != key]
    renamed = changes.withColumnsRenamed({c: f"_new_{c}" for c in fields})
    df = rows.join(renamed, key, "left")
    return df.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])


def patch_ids(rows: DataFrame, ids: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """``rows`` with ``values`` where the key is among ``ids``."""
    df = rows.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return df.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in values.items()}).drop("_hit").select(*rows.columns)


#: What reprocessing puts back.
RESET = {"deduplication_status": "pending", "dedup_group_id": None, "curation_score": None}


def reset_downstream(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.lit(v).cast(rows.schema[c].dataType) for c, v in RESET.items() if c in rows.columns})


def reprocess_candidates(rows: DataFrame, before: Column, limit: int | None = None) -> DataFrame:
    """Completed rows with a text, last updated before a moment; oldest first where a limit is set."""
    found = rows.where((F.col("status") == "COMPLETED") & (F.trim("content") != "") & (F.col("updated_at") < before))
    return found if limit is None else found.orderBy("updated_at", "id").limit(limit)


def latest_per_key(rows: DataFrame, key: str, by: str, tie: str) -> DataFrame:
    """One row a key: the greatest ``by``, nulls last, then the greatest ``tie``."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(by), F.desc(tie))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def create_runs(requests: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """A PROCESSING playlist for each request that lists videos (items: key, video_id, duration), with their number and summed seconds and zero counters."""
    listed = items.groupBy(key).agg(F.count("video_id").alias("video_count"), F.coalesce(F.sum("duration"), F.lit(0)).cast("long").alias("total_duration")).where("video_count > 0")
    zero = F.lit(0).cast("long")
    return requests.join(listed, key).withColumns({"status": F.lit("PROCESSING"), "completed": zero, "failed": zero})


def seed_rows(items: DataFrame, key: str, video: str) -> DataFrame:
    """A PROCESSING row for each video of a playlist, with its place by the video's order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(video))
    return items.select(key, video, place.alias("video_index"), F.lit("PROCESSING").alias("status"), F.lit(None).cast("string").alias("error_message"))


def process_rows(seeds: DataFrame, captions: DataFrame, key: str, video: str) -> DataFrame:
    """Seed rows with the outcome of their captions (video, success, error_type): those after a playlist's first rate limit are not tried and become errors.

    A video without any caption row has no transcript.
    """
    got = seeds.join(captions, video, "left")
    limited = F.coalesce(F.col("error_type") == "rate_limited", F.lit(False))
    before = Window.partitionBy(key).orderBy("video_index").rowsBetween(Window.unboundedPreceding, -1)
    after = F.coalesce(F.max("_limited").over(before), F.lit(0)) == 1
    df = got.withColumn("_limited", limited.cast("int")).withColumn("_after", after)
    good = ~F.col("_after") & F.coalesce(F.col("success"), F.lit(False))
    message = F.when(F.col("_after"), L.CANCELLED).when(F.col("_limited") == 1, L.RATE_LIMITED).when(~good, L.CAPTION_MESSAGES["no_transcript"])
    df = df.withColumns({"status": F.when(good, "COMPLETED").otherwise("ERROR"), "error_message": message, "rate_limited": F.col("_limited") == 1})
    return df.drop("_limited", "_after", "success", "error_type")
