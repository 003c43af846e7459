import hashlib
import pathlib
import textwrap

import duckdb
import pytest

from quillsieve.llm import licenses

COMMON = pathlib.Path("/usr/share/common-licenses")
BY_FILE = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}


def wrapped(text, width):
    """Paragraphs filled anew; a line that begins with a copyright mark stays a line of its own."""
    out = []
    for paragraph in text.split("\n\n"):
        held = []
        for line in [*paragraph.split("\n"), None]:
            if line is None or line.strip().lower().startswith(("copyright (c)", "copyright [", "copyright 20")):
                out.append(textwrap.fill(" ".join(held), width))
                held = []
                if line is not None:
                    out.append(line)
            else:
                held.append(line.strip())
        out.append("")
    return "\n".join(out)


def varied(name, text):
    """Forms of one text that files of it have."""
    title = {"MIT": "The MIT License (MIT)", "ISC": "ISC License", "BSD-3-Clause": "BSD 3-Clause \"New\" or \"Revised\" License", "Apache-2.0": ""}.get(name, "")
    yield f"{title}\n\nCopyright (c) 2020-2024 A. Holder <a@b.org>\nAll rights reserved.\n\n{text}"
    yield f"Copyright 1999 B\n  (c) 2021 C\n\u00a9 D\n\n{text}".replace('"', "\u201c").replace("'", "\u2019")
    yield "\n".join(f" * {line}" for line in f"Portions Copyright \u00a9 2001 E\n\n{text}".split("\n"))
    yield f"{title}\n\nCopyright Foo Bar\n\n{text}"
    yield f"Copyright (c) 2020 A. Holder and\n    others, see the list of authors <x@y.org>\n\n{text}" if len(text) < 3000 else text
    yield " ".join(f"{title} Copyright (c) 2020 A. Holder. All rights reserved. {text}".split()) if len(text) < 3000 else text
    yield " ".join(text.split())
    yield text.upper().replace(",", " ;").replace("SUBLICENSE", "sub-licence").replace("\n", "\r\n")
    yield text.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "- ") if "1. " in text and len(text) < 3000 else text
    for width in range(60, 101, 4):
        yield wrapped(text, width)


def texts():
    found = list(licenses.KNOWN_LICENSES)
    for file, name in BY_FILE.items():
        if (COMMON / file).exists():
            found.append((name, (COMMON / file).read_text(errors="replace")))
    return found


def test_every_form_of_every_entry_is_found(spark):
    rows = [(k, text, name) for k, (name, text) in enumerate((n, v) for n, t in texts() for v in varied(n, t))]
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, want string")).collect()}
    assert {k: got[k] for k, *_ in rows} == {k: name for k, _, name in rows}


@pytest.mark.parametrize("file, cut", [("Apache-2.0", "END OF TERMS"), ("GPL-3", "END OF TERMS")])
def test_terms_without_the_appendix(spark, file, cut):
    if not (COMMON / file).exists():
        pytest.skip("no such file here")
    text = (COMMON / file).read_text(errors="replace")
    got = licenses.scan_licenses(spark.createDataFrame([(1, text[: text.index(cut)])], "doc_id long, text string")).first()
    assert got.license_id == BY_FILE[file]


def test_what_is_no_licence_or_another_one(spark, tmp_path):
    known = dict(licenses.KNOWN_LICENSES)
    mit = known["MIT"]
    rows = [
        (1, mit, "a"), (2, mit + " more", "a"), (3, mit.replace("free of charge", "for a fee"), "a"), (4, None, "a"), (5, "", "a"), (6, "Copyright 2020 X\n(c) 1999", "a"),
        (1, mit, "a"), (None, mit, "a"), (7, known["ISC"].replace("copyright notice", "\ncopyright notice"), "a"), (8, "words " * 100_000, "a"), (9, mit.replace("and/or", "or"), "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license_id string")
    got = licenses.scan_licenses(docs)
    assert sorted((r.doc_id or 0, r.license_id) for r in got.collect() if r.license_id) == [(0, "MIT"), (1, "MIT"), (1, "MIT"), (7, "ISC")]
    assert {r.digest for r in got.collect() if r.doc_id in (4, 5, 6)} == {hashlib.sha256(b"").hexdigest()}
    docs.write.parquet(f"{tmp_path}/docs")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/docs/*.parquet'")
    assert sorted(con.execute(licenses.oracle()).fetchall(), key=str) == sorted((tuple(r) for r in got.collect()), key=str)
    assert licenses.scan_licenses(docs, most_broadcast=0).where("license_id = 'MIT'").count() == 3
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    assert licenses.scan_licenses(docs, known=(), digests=(("own", hashlib.sha256(b"x").hexdigest()),)).where("license_id is not null").count() == 0


def test_a_notice_is_short_and_leads(spark, tmp_path):
    mit = dict(licenses.KNOWN_LICENSES)["MIT"]
    rows = [
        (1, f"Copyright Foo {mit}", "MIT"), (2, f"Copyright {'x ' * 300}{mit}", None), (3, f"Our terms. Copyright Foo {mit}", None),
        (4, f"Copyright Foo {mit[10:]}", None), (5, "copyright permission is hereby granted", None), (6, f"Copyright Foo {mit}\n\nCopyright Bar", None),
        (7, "copyright " * 50_000 + mit, None), (8, f"\n # The MIT License:\n # (c) Foo\n # {mit}", "MIT"), (9, "© 2020 Foo. Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0-notice"),
    ]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = [tuple(r) for r in licenses.scan_licenses(docs).collect()]
    assert {k: name for k, _, name in got} == {k: name for k, _, name in rows}
    docs.write.parquet(f"{tmp_path}/docs")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/docs/*.parquet'")
    assert sorted(con.execute(licenses.oracle()).fetchall()) == sorted(got)


def test_a_registry_of_ones_own(spark):
    docs = spark.createDataFrame([(1, "Use it,\n freely!"), (2, "use it")], "doc_id long, text string")
    got = licenses.scan_licenses(docs, known=(("own", "USE IT freely"),), digests=(("short", hashlib.sha256(b"use it").hexdigest()),))
    assert {r.doc_id: r.license_id for r in got.collect()} == {1: "own", 2: "short"}
