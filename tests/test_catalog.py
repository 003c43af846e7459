"""Every registered query of the library against its SQL, at the smallest scale."""

import datetime
import decimal
import math

import duckdb
import pytest

from quillsieve.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return tuple(map(plain, x)) if isinstance(x, list) else x


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    if name not in catalog.oracle_sql():
        assert got
        return
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


HARD = [
    "a a a b", "the cat the cat the cat sat", "go on now go on now. Go Go", "no. no. no", "x y z x y z x y z x", "  ", "", "Uh uh  uh a b A B", "Wait... what!what ? ok",
    "a b a b a b a b a", "one two three one two three four four four", "é É è", " . , ; ", "3.5 and 4,5 .. .", "word " * 200, "no sentence mark " * 50, "First one. " * 90, "x" * 1300 + ". Then.",
    "a b c d e f g h i j", "the the the a a a b b b c c c d d d e", " ".join(f"w{k % 17}" for k in range(400)), "line\n\n\n\nline two\t\tend\u00a0!", '"Yes!" "Yes!" yes yes',
]


@pytest.mark.parametrize("name", ["t13_collapse_repetitions", "t17_normalize_sentences", "m1_m2_mtld", "x1_x2_w6_chunks"])
def test_folds_equal_their_sql_on_hard_texts(spark, tmp_path, name):
    rows = [(k, t, ["en", "pt", "fr"][k % 3], "web", len(t)) for k, t in enumerate(HARD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = catalog.queries()[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in con.execute(f"select {', '.join(columns)} from ({catalog.oracle_sql()[name]})").fetchall()), key=repr)


def test_entry_points(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
