"""Datasets as whole files: joined parts parse in every format."""

import csv
import io
import json
import xml.etree.ElementTree as ET
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillsieve.operators import export

TEXTS = ["a\n>>>\nb", 'say "hi", you', "<ok> & 'x'", "", None, "---\n## text"]


def rows(spark, n, parts=5):
    none = {f: F.lit(None).cast("string") for f in export.FIELDS}
    text = F.element_at(F.array(*[F.lit(t) for t in TEXTS]), (F.col("k") % len(TEXTS) + 1).cast("int"))
    made = none | {"id": F.format_string("%05d", "k"), "text": text, "title": F.concat(F.lit("t"), "k")}
    return spark.range(n).withColumnRenamed("id", "k").repartition(parts).select(*[made[f].alias(f) for f in export.FIELDS])


def joined(path):
    assert not [p for p in Path(path).iterdir() if not p.name.startswith(("part-", ".part-"))]
    return "".join(p.read_bytes().decode() for p in sorted(Path(path).glob("part-*")))


@pytest.mark.parametrize("n", [0, 1, 57])
def test_joined_parts_are_one_file(spark, tmp_path, n):
    found = {}
    for fmt in export.MIME_TYPES:
        assert export.write_dataset(rows(spark, n), fmt, "raw", ["id"], f"{tmp_path}/{fmt}") == export.MIME_TYPES[fmt]
        found[fmt] = joined(f"{tmp_path}/{fmt}")
    ids = [f"{k:05}" for k in range(n)]
    parsed = json.loads(found["json"])
    assert [r["id"] for r in parsed] == ids and [r["text"] for r in parsed] == [TEXTS[k % len(TEXTS)] for k in range(n)]
    table = list(csv.reader(io.StringIO(found["csv"])))
    assert table[0] == export.FIELDS and [r[0] for r in table[1:]] == ids
    root = ET.fromstring(found["xml"])
    assert root.get("recordCount") == str(n) and [r.find("id").text for r in root] == ids
    assert found["txt"].startswith(f"# dataset: raw\n# records: {n}") and found["txt"].count("\n<<<RECORD>>>\n") == n == found["txt"].count("\n<<<END>>>")
    assert found["md"].startswith(f"# Dataset\n\n- stage: raw\n- records: {n}") and found["md"].count("\nid: ") == n
    assert not found["csv"].endswith("\n") and "\n\n\n" not in found["txt"]


def test_a_failed_job_leaves_no_file_and_a_repeated_task_is_taken_once(spark, tmp_path):
    df = rows(spark, 40)
    bad = df.withColumn("title", F.when(F.col("id") == "00033", F.raise_error(F.lit("broken"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="broken"):
        export.write_dataset(bad, "json", "raw", ["id"], f"{tmp_path}/out")
    left = [p for p in (tmp_path / "out").rglob("*") if p.is_file()] if (tmp_path / "out").exists() else []
    assert not left
    export.write_dataset(df, "json", "raw", ["id"], f"{tmp_path}/out")
    assert len(json.loads(joined(f"{tmp_path}/out"))) == 40
    export.write_dataset(df.limit(3), "json", "raw", ["id"], f"{tmp_path}/out", overwrite=True)
    assert len(json.loads(joined(f"{tmp_path}/out"))) == 3
