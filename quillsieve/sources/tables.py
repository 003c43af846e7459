"""Schemas, readers, writers and the memo table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillsieve.functions import text as T

SNIPPET = "struct<text:string,start:double,duration:double>"
CURATION = "struct<coherence:double,richness:double,factuality:double,overall:double,rationale:string,provider:string,model:string,chunkCount:int>"
SCHEMAS = {
    "users": "id string, email string, name string, avatar string, provider string, is_active boolean, email_verified boolean, created_at timestamp, updated_at timestamp",
    "transcriptions": "id string, user_id string, youtube_id string, title string, type string, thumbnail string, status string, content string, duration int, word_count int, language string, error_message string, processing_started_at timestamp, completed_at timestamp, created_at timestamp, updated_at timestamp, "
    f"timestamps array<{SNIPPET}>, processed_content string, is_processed boolean, quality_score double, mtld_score double, mattr_score double, curation_score double, curation {CURATION}, deduplication_status string, dedup_group_id string, is_playlist_video boolean, playlist_id string, video_index int",
    "playlists": "id string, user_id string, youtube_id string, title string, description string, channel_title string, channel_id string, thumbnail string, video_count int, status string, total_duration int, total_word_count int, error_message string, processing_started_at timestamp, completed_at timestamp, created_at timestamp, updated_at timestamp",
    "exports": "id string, transcription_id string, format string, file_url string, file_size int, status string, error_message string, created_at timestamp, completed_at timestamp",
    "recent_activity": "id string, user_id string, description string, metadata map<string,string>, created_at timestamp, action string",
    "captions": f"video_id string, success boolean, raw_text string, word_count int, language_code string, is_generated boolean, timestamps array<{SNIPPET}>, error string, error_type string",
    "corpus": "id string, lang string, text string",
    "blacklist": "token string, user_id string, blacklisted_at timestamp, expires_at timestamp, reason string",
}


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {id, lang, text}."""
    return spark.read.schema(SCHEMAS["corpus"]).option("multiLine", True).json(path)


def read_labels(spark: SparkSession, path: str, schema: str = "id string, outcome string") -> DataFrame:
    """A CSV file with a header; quoted fields may hold line ends."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_payloads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line as ``payload``, with the reason in ``rejected`` for what is empty or none."""
    lines = spark.read.text(path)
    return lines.select(parsed_payload(F.col("value"), schema).alias("payload"), payload_error(F.col("value")).alias("rejected"))


def parsed_payload(line: Column, schema: str) -> Column:
    return F.when(payload_error(line).isNull(), F.from_json(line, schema))


def payload_error(line: Column) -> Column:
    t = F.trim(F.coalesce(line, F.lit("")))
    return F.when(t == "", "empty").when(F.try_parse_json(t).isNull(), "invalid").when(~t.startswith("{"), "not an object")


def corpus_rows(transcriptions: DataFrame, least_chars: int = 200) -> DataFrame:
    """The latest completed row of each video with more than ``least_chars`` characters."""
    from quillsieve.operators.playlists import latest_per_key

    rows = transcriptions.where((F.col("status") == "COMPLETED") & (F.length("content") > least_chars))
    return latest_per_key(rows, "youtube_id", "created_at", "id").select("id", F.col("language").alias("lang"), F.col("content").alias("text"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def memoised(inputs: DataFrame, memo: DataFrame, key: list[str], compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all results, new memo rows): ``compute`` sees only inputs whose SHA-1 key the memo lacks; the memo has ``cache_key`` and the results."""
    keyed = inputs.withColumn("cache_key", F.sha1(F.to_json(F.array(*[F.col(k).cast("string") for k in key]))))
    fresh = compute(keyed.join(memo.select("cache_key"), "cache_key", "left_anti")).select(*memo.columns)
    return keyed.join(memo.unionByName(fresh).dropDuplicates(["cache_key"]), "cache_key"), fresh


def assemble_caption(snippets: Column | str, position: str | None = None) -> Column:
    """(text, word count, seconds) of an array of snippets, in their order."""
    s = F.col(snippets) if isinstance(snippets, str) else snippets
    text = F.array_join(F.transform(s, lambda x: x["text"]), " ")
    count = F.size(F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != ""))
    seconds = F.coalesce(F.array_max(F.transform(s, lambda x: x["start"] + x["duration"])), F.lit(0.0))
    return F.struct(text.alias("raw_text"), count.alias("word_count"), seconds.alias("duration_seconds"))


# Languages of captions in the order they are tried.
PREFERRED_LANGUAGES = ("pt", "pt-BR", "pt-PT", "en", "en-US", "en-GB", "es", "fr", "de")


def pick_caption(tracks: DataFrame, video: str = "video_id") -> DataFrame:
    """One track a video from (language_code, is_generated): a preferred language first, else Portuguese, English, others; manual before automatic."""
    code = F.col("language_code")
    place = F.array_position(F.array(*[F.lit(c) for c in PREFERRED_LANGUAGES]), code).cast("int")
    low = F.lower(code)
    rank = F.when(place > 0, place).when(low.startswith("pt"), 100).when(low.startswith("en"), 101).otherwise(102)
    order = F.struct(rank, F.col("is_generated"), code)
    return tracks.groupBy(video).agg(F.min_by(F.struct("language_code", "is_generated"), order).alias("track")).select(video, "track.*")


def fetch_captions(requests: DataFrame, tracks: DataFrame, video: str = "video_id") -> DataFrame:
    """One row a requested video: the preferred track of ``tracks`` (video, language_code, is_generated, raw_text) or why there is none.

    Equally preferred tracks go by their text. A video without an id is an invalid one.
    """
    code = F.col("language_code")
    place = F.array_position(F.array(*[F.lit(c) for c in PREFERRED_LANGUAGES]), code).cast("int")
    low = F.lower(code)
    rank = F.when(place > 0, place).when(low.startswith("pt"), 100).when(low.startswith("en"), 101).otherwise(102)
    best = tracks.groupBy(video).agg(F.min(F.struct(rank.alias("rank"), "is_generated", "language_code", "raw_text")).alias("t"))
    got = F.col("t").isNotNull()
    failed = F.when(F.col(video).isNull(), "invalid_video_id").when(~got, "no_transcript")
    return requests.select(video).join(best, video, "left").select(video, got.alias("success"), "t.language_code", "t.is_generated", "t.raw_text", failed.alias("error_type"))


def transcripts_by_url(requests: DataFrame, captions: DataFrame, link: str) -> DataFrame:
    """Each request with ``video_id``, ``raw_text`` and ``error_type``: links that are none of a video, and videos without a caption (video_id, raw_text)."""
    asked = requests.withColumn("video_id", T.video_id(link))
    found = asked.join(captions.select("video_id", "raw_text"), "video_id", "left")
    failed = F.when(F.col("video_id").isNull(), "invalid_url").when(F.col("raw_text").isNull(), "no_transcript")
    return found.withColumn("error_type", failed)


def playlists_by_url(requests: DataFrame, playlists: DataFrame, link: str) -> DataFrame:
    """Each request with the details of the playlist that its link names, and the larger thumbnail there is."""
    asked = requests.withColumn("playlist_id", T.playlist_id(link))
    found = asked.join(playlists, "playlist_id", "left")
    picture = F.when(F.col("title").isNotNull(), thumbnail(F.col("high"), F.col("medium")))
    return found.withColumn("thumbnail", picture).drop("high", "medium")


def playlist_video_ids(pages: DataFrame, key: str = "playlist_id") -> DataFrame:
    """(playlist, video_id) of listing pages, without what the listing says of them."""
    return pages.select(key, F.explode("items.video_id").alias("video_id")).where("video_id is not null")


def thumbnail(high: Column, medium: Column) -> Column:
    return F.coalesce(high, medium, F.lit(""))


def playlist_items(pages: DataFrame, key: str = "playlist_id") -> DataFrame:
    """Items of listing pages (playlist, page_no, items) with a running position among the usable ones."""
    from pyspark.sql import Window

    items = pages.select(key, "page_no", F.posexplode("items").alias("at", "item")).where("item.video_id is not null")
    w = Window.partitionBy(key).orderBy("page_no", "at")
    return items.select(key, F.row_number().over(w).alias("video_index"), "item.*")


class PlaylistSource(DataSource):
    """``format("playlist_pages")``: pages of a listing as rows; option ``fetch`` names a ``module:function`` page reader.

    The function takes (playlist_id, page_token) and returns (items, next token or None);
    each playlist of option ``playlists`` (comma-separated) is a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "playlist_pages"

    def schema(self) -> str:
        return "playlist_id string, page_no int, items array<struct<video_id:string,title:string>>"

    def reader(self, schema) -> DataSourceReader:
        return _PlaylistReader(dict(self.options))


class _PlaylistReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p.strip()) for p in self.options["playlists"].split(",") if p.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, _, function = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), function)
        token, page = None, 0
        while page == 0 or token:
            items, token = fetch(partition.value, token)
            yield partition.value, page, [(i["video_id"], i["title"]) for i in items]
            page += 1
