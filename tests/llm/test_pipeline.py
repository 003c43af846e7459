import corpus_pipeline
from quillsieve.llm import queries


def test_stages_call_their_operators_and_keep_the_columns(spark):
    sf = "/root/testdata/sf0.01"
    docs = queries.table(spark, sf, "documents")
    before = docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "sentencepiece",
    ]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        n = docs.count()
        assert n == before if name == "suffix_array_dedup" else 0 < n < before
        before = n
    assert corpus_pipeline.tokens(spark, docs, sf).count() == before


def test_stages_on_odd_rows(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "é" * 200, "en", "s", 200), (4, "é" * 200, "en", "s", 200), (None, "a b c", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    got = {r.doc_id: r.decoded for r in docs.collect()}
    assert got[1] == "" and got[None] == "a b c" and 4 not in got and set(got[3]) <= {"é"}


def test_run_is_registered(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"](spark, sf_dir).count() > 0
