"""Export admission and dataset files in five formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsieve.functions.text import blank_to_null
from quillsieve.sources.dataset_files import DatasetSink

# The fields of a dataset record in their order, those that are texts, and the MIME types.
FIELDS = """
id title youtubeId playlistId language dataset deduplicationStatus dedupGroupId qualityScore mtldScore mattrScore
llmCurationScore coherence richness factuality curationOverall curationRationale curationProvider curationModel
curationChunkCount text
""".split()
TEXT_FIELDS = ["text"]
SCALARS = [f for f in FIELDS if f not in TEXT_FIELDS]
MIME_TYPES = {
    "json": "application/json;charset=utf-8",
    "csv": "text/csv;charset=utf-8",
    "txt": "text/plain;charset=utf-8",
    "md": "text/markdown;charset=utf-8",
    "xml": "application/xml;charset=utf-8",
}
STAGES = ("raw", "processed", "curated")


def check_scope(scope: str, playlist_id: str | None = None, transcription_id: str | None = None) -> None:
    need = {"playlist": playlist_id, "transcription": transcription_id}
    if scope in need and not need[scope]:
        raise ValueError(f"{scope}Id is required when scope is {scope}")


def export_filename(scope: Column, owner: Column, stage: Column, fmt: Column) -> Column:
    """``scope-owner-stage.format``; the owner is the playlist's, transcription's or user's id."""
    return F.concat(scope, F.lit("-"), owner, F.lit("-"), stage, F.lit("."), fmt)


def export_text(stage: str, content: Column | str, processed: Column | str) -> Column:
    """The raw text at the raw stage, else the processed one or the raw one; null where both are blank."""
    return blank_to_null(content) if stage == "raw" else F.coalesce(blank_to_null(processed), blank_to_null(content))


def disposition(stage: str, include_duplicates: bool, status: Column, dedup_status: Column, has_curation: Column, text: Column) -> Column:
    """Ordered rules: failed, duplicate, uncurated, blank, else exported."""
    out = F.when(status == "ERROR", "failed")
    if not include_duplicates:
        out = out.when(dedup_status == "duplicate", "duplicate")
    if stage == "curated":
        out = out.when(~has_curation, "dropped")
    return out.when(text.isNull(), "failed").otherwise("exported")


def export_counts(rows: DataFrame) -> DataFrame:
    """``records``, ``skippedDuplicates``, ``skippedFailed`` of rows with a ``disposition``."""
    n = lambda kind: F.count_if(F.col("disposition") == kind)
    return rows.agg(n("exported").alias("records"), n("duplicate").alias("skippedDuplicates"), n("failed").alias("skippedFailed"))


def number_text(x: Column) -> Column:
    """A number as JSON writes it: no exponent for usual sizes, no .0 for whole ones."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def _text(df: DataFrame, field: str) -> Column:
    kind = dict(df.dtypes)[field]
    return number_text(F.col(field)) if kind in ("double", "float", "int", "bigint") else F.col(field).cast("string")


def _one_line(x: Column) -> Column:
    return F.regexp_replace(x, r"\r?\n", " ")


def json_quoted(x: Column) -> Column:
    """A JSON string: what ``to_json`` writes for a field, cut out of its object."""
    whole = F.to_json(F.struct(x.alias("v")))
    return F.when(x.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def record_json(df: DataFrame) -> Column:
    """The record as a pretty JSON object, two spaces deep, nulls kept."""
    kinds = dict(df.dtypes)
    value = lambda f: number_text(F.col(f)) if kinds[f] != "string" else json_quoted(F.col(f))
    lines = [F.concat(F.lit(f'    "{f}": '), F.coalesce(value(f), F.lit("null"))) for f in FIELDS]
    return F.concat(F.lit("  {\n"), F.concat_ws(",\n", *lines), F.lit("\n  }"))


def record_csv(df: DataFrame) -> Column:
    def cell(f: str) -> Column:
        x = F.coalesce(_text(df, f), F.lit(""))
        return F.when(x.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)

    cells = [cell(f) for f in FIELDS]
    return F.concat(cells[0], *[F.concat(F.lit(","), c) for c in cells[1:]])


def record_txt(df: DataFrame) -> Column:
    scalars = [F.concat(F.lit(f"{f}: "), F.coalesce(_one_line(_text(df, f)), F.lit(""))) for f in SCALARS]

    def block(f: str) -> Column:
        body = F.replace(F.coalesce(F.col(f), F.lit("")), F.lit("\r\n"), F.lit("\n"))
        lines = F.transform(F.split(body, "\n", -1), lambda x: F.when(x.isin(">>>", "<<<RECORD>>>", "<<<END>>>"), F.concat(F.lit("\\"), x)).otherwise(x))
        body = F.array_join(lines, "\n")
        ended = F.when((body == "") | body.endswith("\n"), body).otherwise(F.concat(body, F.lit("\n")))
        return F.concat(F.lit(f"{f}<<<\n"), ended, F.lit(">>>"))

    return F.concat_ws("\n", F.lit("<<<RECORD>>>"), *scalars, *[block(f) for f in TEXT_FIELDS], F.lit("<<<END>>>"))


def record_md(df: DataFrame) -> Column:
    kinds = dict(df.dtypes)

    def front(f: str) -> Column:
        x = F.col(f)
        if kinds[f] == "string":
            return F.coalesce(json_quoted(_one_line(x)), F.lit("null"))
        odd = F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
        return F.when(x.isNull() | odd, "null").otherwise(number_text(x))

    def section(f: str) -> Column:
        body = blank_to_null(F.replace(F.coalesce(F.col(f), F.lit("")), F.lit("\r\n"), F.lit("\n")))
        return F.concat(F.lit(f"## {f}"), F.coalesce(F.concat(F.lit("\n\n"), body), F.lit("")))

    head = [F.concat(F.lit(f"{f}: "), front(f)) for f in SCALARS]
    return F.concat_ws("\n", F.lit("---"), *head, F.lit("---"), F.lit(""), F.concat_ws("\n\n", *[section(f) for f in TEXT_FIELDS]))


def xml_escape(x: Column) -> Column:
    x = F.regexp_replace(x, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def record_xml(df: DataFrame) -> Column:
    rows = [F.concat(F.lit(f"    <{f}>"), F.coalesce(xml_escape(_text(df, f)), F.lit("")), F.lit(f"</{f}>")) for f in FIELDS]
    return F.concat(F.lit("  <record>\n"), F.concat_ws("\n", *rows), F.lit("\n  </record>"))


_RECORD = {"json": record_json, "csv": record_csv, "txt": record_txt, "md": record_md, "xml": record_xml}
_BETWEEN = {"json": ",\n", "csv": "\n", "txt": "\n\n", "md": "\n\n", "xml": "\n"}


def envelope(fmt: str, stage: str, n: int | str) -> tuple[str, str]:
    """What stands before the first and after the last record."""
    if fmt == "json":
        return ("[\n", "\n]") if n else ("[", "]")
    if fmt == "csv":
        return ",".join(FIELDS) + ("\n" if n else ""), ""
    if fmt == "txt":
        return f"# dataset: {stage}\n# records: {n}" + ("\n\n" if n else ""), ""
    if fmt == "md":
        return f"# Dataset\n\n- stage: {stage}\n- records: {n}" + ("\n\n" if n else ""), ""
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<dataset recordCount="{n}" stage="{stage}">\n', "\n</dataset>\n" if n else "</dataset>\n"


def serialize(df: DataFrame, fmt: str, order: list[str]) -> DataFrame:
    """The rows with their serialised ``record``; sorted by range, so files in name order make one dataset."""
    if fmt not in _RECORD:
        raise ValueError(f"unknown format {fmt}")
    return df.select(*order, _RECORD[fmt](df).alias("record")).orderBy(*order)


def write_dataset(df: DataFrame, fmt: str, stage: str, order: list[str], path: str, overwrite: bool = False) -> str:
    """Writes a folder whose files, joined in the order of their names, are the whole dataset; returns its MIME type.

    The plan runs once: the number of records comes with the tasks' commits. An empty table gives a valid file too, and a
    job that fails leaves no file.
    """
    spark = df.sparkSession
    spark.dataSource.register(DatasetSink)
    options = {"path": path, "between": _BETWEEN[fmt]}
    for name, n in (("", "{n}"), ("_empty", 0)):
        options[f"head{name}"], options[f"tail{name}"] = envelope(fmt, stage, n)
    rows = serialize(df, fmt, order).select("record")
    rows.write.format(DatasetSink.name()).mode("overwrite" if overwrite else "append").options(**options).save()
    return MIME_TYPES[fmt]


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The written files as (name, text), for checks of small datasets; a reader of a large one joins the files themselves."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.decode("content", "UTF-8").alias("text"))
