"""What punctuation and text rules cost: equal words are aligned in one pass, and few rows of a batch are strings at once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillsieve.functions import text as T
from quillsieve.operators import alignment, punctuation


def test_equal_words_need_no_search_for_blocks(monkeypatch):
    monkeypatch.setattr(alignment, "matching_blocks", lambda *_: pytest.fail("searched"))
    assert punctuation.project("né the 12 the end", "Né, the 12 The end.") == "Né, the 12 The end."


def test_few_rows_of_a_batch_are_strings_at_once():
    class Batch:
        taken = 0

        def __len__(self):
            return 10_000

        def slice(self, k, n):
            self.taken += n
            return pa.array([["a", "b"], None] * (n // 2))

    batch = Batch()
    rows = punctuation.few_at_a_time(iter([batch]))
    assert [next(rows), next(rows)] == [["a", "b"], []] and batch.taken <= 100
    assert sum(1 for _ in rows) == 9_998 + (-10_000 % punctuation._ROWS)


def test_words_are_only_counted_where_marks_may_lack(spark):
    rows = spark.createDataFrame([("a " * 30,), ("a. " * 30,), ("a",), (None,)], "text string").select(T.needs_punctuation("text").alias("v"))
    assert "regexp_extract_all" not in rows._jdf.queryExecution().analyzed().toString()
    assert [r.v for r in rows.collect()] == [True, False, False, None]


def test_runs_that_end_a_sentence_stay_beside_shorter_ones(spark):
    texts = ["oh so it. oh so it. it it", "x y. x y. y y", "A a. a. b B b c", "go! go! go go"]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select(T.fold_runs(T.single_spaced(F.col("x"))).alias("v")).collect()
    assert [r.v for r in got] == ["oh so it. oh so it. it", "x y. x y. y", "A a. a. b c", "go! go! go"]
