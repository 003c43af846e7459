import random
import re

import pytest
from pyspark.sql import functions as F

from quillsieve.functions import metrics as M
from quillsieve.functions import text as T
from quillsieve.operators import clean


@pytest.fixture(scope="module")
def run(spark):
    """Values of one expression for many inputs, in their order."""

    def values(inputs, expression, schema="x string"):
        rows = [(k, *(v if isinstance(v, tuple) else (v,))) for k, v in enumerate(inputs)]
        got = spark.createDataFrame(rows, f"k int, {schema}").select("k", expression.alias("v")).collect()
        return [r.v for r in sorted(got, key=lambda r: r.k)]

    return values


@pytest.mark.parametrize(
    "text, words",
    [("Olá, mundo!", ["Olá", "mundo"]), ("d'água it’s re-do", ["d'água", "it’s", "re-do"]), ("a1b _x_ ½", ["a", "b", "x", "½"]), ("", [])],
)
def test_words(run, text, words):
    assert run([text], T.words("x")) == [words]


def test_languages(run):
    assert run(["pt-BR", "EN_us", " fr ", "", None, "-x"], T.normalize_language("x")) == ["pt", "en", "fr", "en", "en", "en"]
    assert run(["the cat and the dog of it", "o que não é uma casa", "short"], T.function_word_language("x", F.lit("de"))) == ["en", "pt", "de"]


def test_exact_hash_ignores_case_and_marks_not_accents(run):
    a, b, c, d = run(["Hello, world!", "hello world", "olá mundo", "ola mundo"], T.exact_hash("x"))
    assert a == b and c != d


def test_timestamps(run):
    n, t = T.timestamp_count_and_text(F.col("x"))
    assert run(["[00:12] oi (1:02:03) às 12:30 e 01:02,5 fim 2:3"], n) == [4]
    assert run(["[00:12] oi 12:30"], t) == ["  oi  "]


@pytest.mark.parametrize("note", ["[SUSPIRANDO]", "(risadas)", "{silêncio}", "(música tocando)", "[music]", "♪música♪", "[a [b] c]"])
def test_nonverbal_notes_go(run, note):
    assert re.sub(r"\s+", " ", run([f"antes {note} depois"], T.remove_nonverbal("x"))[0]) == "antes depois"


@pytest.mark.parametrize("depth", [1, 8, 9, 40])
def test_brackets_and_tags_go_at_any_depth(run, depth):
    nested = "a " + "[x" * depth + "]" * depth + " b [c"
    tags = "<tag" * depth + "<TAG>" + ">" * depth + "z"
    assert re.sub(r" +", " ", run([nested, None], T.remove_nonverbal("x"))[0]) == "a b [c"
    assert run([tags, None, ""], T.strip_tags("x", ("tag",))) == ["z", None, ""]


@pytest.mark.parametrize("kept", ["(como eu disse)", "(2020)", "(risadas 2)", "()"])
def test_spoken_brackets_stay(run, kept):
    assert run([f"antes {kept} depois"], T.remove_nonverbal("x")) == [f"antes {kept} depois"]


def plain_fold(text):
    """A longest-first scan for a unit that the next tokens repeat; independent of the pattern under test."""
    tokens, out, gone, k = text.split(), [], 0, 0
    low = [t.lower() for t in tokens]
    ends = [bool(re.search(r"""[.!?]["'”’)\]]*$""", t)) for t in tokens]
    while k < len(tokens):
        n = next((n for n in (3, 2, 1) if not any(ends[k : k + n]) and len(low[k : k + n]) == n and low[k : k + n] == low[k + n : k + 2 * n]), 0)
        out += tokens[k : k + max(n, 1)]
        step = max(n, 1)
        while n and low[k : k + n] == low[k + step : k + step + n]:
            step += n
            gone += n
        k += step
    return " ".join(out), gone


def test_repetitions_equal_a_plain_scan(run):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "B", "b", "é", "c.", "c", 'd!"', "É"]) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    folded, removed = T.collapse_repetitions("x")
    assert list(zip(run(texts, folded), run(texts, removed), strict=True)) == [plain_fold(t) for t in texts]


def test_orphan_commas_equal_a_plain_scan(run):
    rng = random.Random(2)
    texts = ["".join(rng.choice([",", " ", "a", "3", "_", "!", "é", "\n"]) for _ in range(rng.randint(0, 14))) for _ in range(1500)]

    def plain(t):
        t = re.sub(r",\s*([.;:!?])", r"\1", re.sub(r",(\s*,)+", ",", t))
        spoken = lambda c: c.isalnum()
        keep = []
        for k, c in enumerate(t):
            before, after = t[:k].rstrip()[-1:], t[k + 1 :].lstrip()[:1]
            keep.append(c != "," or (spoken(before) and spoken(after)))
        return "".join(c for c, k in zip(t, keep, strict=True) if k)

    assert run(texts, T.strip_orphan_commas("x")) == [plain(t) for t in texts]


@pytest.mark.parametrize(
    "text, clean_",
    [
        ("a.com and U.S. ok", "A. Com and U. S. Ok."),
        ("oi..  tudo   bem ?sim", "Oi... Tudo bem? Sim."),
        ("Is the lamp on? . It glows.", "Is the lamp on? It glows."),
        ("", ""),
        ("3.5 é certo", "3.5 é certo."),
        ("já é\n\n\n\nfim!", "Já é\n\nfim!"),
    ],
)
def test_normalize_sentences(run, text, clean_):
    assert run([text], T.normalize_sentences("x")) == [clean_]


def test_capitals_are_one_character(run):
    """ß at a sentence start became SS, where SQL has ẞ; letters without a single capital stay."""
    assert run(["ßer da. ßau. ﬁn"], T.normalize_sentences("x")) == ["ẞer da. ẞau. ﬁn."]
    assert run(["ßa.ᾳb@x"], T.name_from_email("x")) == ["ẞa ᾼb"]


def test_sentences(run):
    assert run(["Uma frase. Outra! E outra? Fim."], T.split_sentences("x")) == [["Uma frase.", "Outra!", "E outra?", "Fim."]]


def processed(spark, text, lang="en", **options):
    return clean.process(spark.createDataFrame([(text, lang)], "text string, lang string"), **options).first()


@pytest.mark.parametrize(
    "text, lang, want",
    [
        ("the the the kettle sings sings softly.", "en", "The kettle sings softly."),
        ("Who took my umbrella? Uhm. Nobody did.", "en", "Who took my umbrella? Nobody did."),
        ("We grow beans. Erm... Splendid!", "en", "We grow beans. Splendid!"),
    ],
)
def test_process_golden(spark, text, lang, want):
    assert processed(spark, text, lang).processed_text == want


def test_process_keeps_what_is_speech(spark):
    r = processed(spark, "Vi um gato e um peixe no quintal da vizinha, né.", "pt")
    assert r.processed_text.split().count("um") == 2 and "né" not in r.processed_text and r.hesitation_count == 1
    assert "Row harder. Row harder." in processed(spark, "Row harder. Row harder. Now rest.").processed_text
    r = processed(spark, "o preço subiu de 7,10 para 8,45 nesta semana.", "pt").processed_text
    assert "7,10" in r and "8,45" in r
    assert processed(spark, "nós [tosse], depois voltamos para casa.", "pt").processed_text.startswith("Nós, depois")
    assert clean.process(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).where("processed_text = ''").count() == 2


def test_processing_never_lowers_the_score(spark):
    samples = [
        "uh my my neighbour keeps three goats um , , and a very old donkey behind the barn",
        "[music] they were were painting the fence 12:30 hmm when the rain began to fall",
        "tonight , she reads reads the letter um , that came with the morning boat",
    ]
    rows = spark.createDataFrame([(t, "en") for t in samples], "text string, lang string")
    raw = {r.text: r.quality_score for r in clean.analyze(rows).collect()}
    assert all(r.quality_score >= raw[r.text] for r in clean.process(rows).collect())


def test_accents_are_restored_and_unknown_words_stay(spark):
    words = [("pt", w, n) for w, n in (("maçã", 9), ("não", 9), ("estação", 9), ("estaçao", 2))]
    dictionary = spark.createDataFrame(words, "lang string, word string, n long")
    rows = spark.createDataFrame([("Maca nao cresce na estacao fria, zzkwy.", "pt"), (None, "pt"), ("nao", "xx")], "text string, lang string")
    for most_rows in (1, 100):  # one pass over the texts for each part of the changes
        got = [r.text for r in clean.restore_accents(rows, dictionary, "text", "lang", F.lit(True), most_rows=most_rows).collect()]
        assert got == ["Maçã não cresce na estação fria, zzkwy.", None, "nao"]
    assert clean.restore_accents(rows, dictionary, "text", "lang", F.lit(False)).first().text.startswith("Maca nao")


def test_mtld(run):
    words = ["alpha", "beta", "gamma"] * 12
    got = run([words, words[::-1], words[:9], words[:10], []], M.mtld("x"), "x array<string>")
    assert got[0] == got[1] and got[2] is None and got[3] is not None and got[4] is None


def test_mattr_and_diversity(run):
    rng = random.Random(3)
    arrays = [["one", "two", "two"], [], *[[rng.choice("abcdefgh") for _ in range(n)] for n in (49, 50, 51, 120)]]

    def plain(w):
        return len(set(w)) / len(w) if 0 < len(w) < 50 else sum(len(set(w[k : k + 50])) / 50 for k in range(len(w) - 49)) / (len(w) - 49) if w else 0

    assert run(arrays, M.mattr("x"), "x array<string>") == pytest.approx([plain(w) for w in arrays])
    assert run([["a", "A", "a", "b", "b"], []], M.immediate_repetitions(F.col("x")), "x array<string>") == [3, 0]


def test_over_deletion_lowers_quality(run):
    q = lambda noise: run([0], M.quality(F.lit(12.0), F.lit(0.0), F.lit(0.0), F.lit(noise)), "x int")[0]
    assert q(0.2) == q(0.75) == 1.0 and q(0.8) == pytest.approx(0.8) and q(1.0) == 0


def test_readability(run):
    assert run(["", "A cat sat."], M.run_on_rate("x")) == [1.0, 0.0]
    assert run(["word " * 41 + "."], M.run_on_rate("x")) == [1.0]
    assert run(["The cat sat."], M.flesch("x", F.lit("en"))) == pytest.approx([100.0])
    assert run([""], M.flesch("x", F.lit("pt"))) == [0.0]


def test_links_and_durations(run):
    urls = ["https://www.youtube.com/watch?v=abc123&t=1", "https://youtu.be/xyz?si=1", "https://youtube.com/v/q1#z", "https://example.com"]
    assert run(urls, T.video_id("x")) == ["abc123", "xyz", "q1", None]
    assert run(["https://youtube.com/playlist?list=PL1&x=1", "https://youtube.com/watch?v=a&list=PL2"], T.playlist_id("x")) == ["PL1", "PL2"]
    assert run(["PT1H2M3S", "PT90M", "P1D", "x"], T.iso_duration_seconds("x")) == [3723, 5400, 0, 0]
    assert run([3723, 180, 65, 5, 0, None], T.format_duration("x"), "x int") == ["1h 2m", "3m", "1m 5s", "5s", "—", "—"]
    assert run(["ana.silva@x", "JOSE_luis@x", "a-b@x", "@x", "solo"], T.name_from_email("x")) == ["Ana Silva", "Jose Luis", "A B", "User", "Solo"]


def test_model_replies(run):
    assert run(["Version A", "version_b", " B. ", "both", None], T.normalize_winner("x")) == ["A", "B", "B", "tie", "tie"]
    assert run(['x ```json\n{"a": 1}\n``` {z', 'so {"a": {"b": 2}} end', "none", None], T.json_object("x")) == ['{"a": 1}', '{"a": {"b": 2}}', None, None]
    assert run(["7.126", "11", "-1", "nan", "Infinity", "high", None], T.score(F.col("x"))) == [7.13, 10.0, 0.0, None, None, None, None]
    nested = "a<tran<transcript>script>b</ TRANSCRIPT >c"
    assert run([nested], T.wrap_excerpt("x")) == ["<transcript>\nabc\n</transcript>"]


N = 100_000


@pytest.mark.parametrize(
    "text, expression, want",
    [
        ("-".join("a" * N), lambda: T.words("x"), ["-".join("a" * N)]),
        (", " * N, lambda: T.strip_orphan_commas("x"), lambda v: "," not in v),
        ("a, " * N, lambda: T.strip_orphan_commas("x"), lambda v: v.count(",") == N - 1),
        ("oi " * N, lambda: T.collapse_repetitions("x")[0], plain_fold("oi " * N)[0]),
        ("a b c " * N, lambda: T.collapse_repetitions("x")[0], "a b c"),
        ("x! " * N, lambda: T.normalize_sentences("x"), lambda v: v.count("!") == N),
        ("! " * N, lambda: T.normalize_sentences("x"), lambda v: set(v) <= {"!", " ", "."}),
        ("a. " * N, lambda: T.split_sentences("x"), ["a."] * N),
        ("-".join("a" * N), lambda: T.remove_fillers("x", F.lit("en")), "-".join("a" * N)),
        ("(" * N, lambda: T.remove_nonverbal("x"), "(" * N),
        ("a" * N + ".", lambda: T.collapse_repetitions("x")[0], "a" * N + "."),
        ("1:23 " * N, lambda: T.timestamp_count_and_text(F.col("x"))[0], N),
        (("a" * 60 + " ") * 2000, lambda: T.sentence_words("x"), [["a" * 60] * 2000]),
    ],
)
def test_no_repetition_overflows_the_stack(run, text, expression, want):
    got = run([text], expression())[0]
    assert want(got) if callable(want) else got == want


def test_time_marks_in_other_digits(run):
    assert run(["às ١٢:٣٠ e 12:30"], T.timestamp_count_and_text(F.col("x"))[0]) == [2]


def test_a_speller_that_fails_is_left_out(spark):
    def speller(text, lang):
        if "bad" in text:
            raise ValueError
        return text.replace("teh", "the")

    rows = spark.createDataFrame([("teh bad word", "en"), ("teh word", "en"), (None, "en")], "text string, lang string")
    got = [(r.processed_text, r.spelling_failed) for r in clean.process(rows, speller=speller).collect()]
    assert got == [("Teh bad word.", True), ("The word.", False), ("", False)]


def test_accents_beyond_a_broadcast_send_no_table_to_tasks(spark, monkeypatch):
    """The changes of a large corpus were broadcast in parts that one task held all at once."""
    words = [a + b + "ção" for a in "bcdfg" for b in "aeiou"]
    dictionary = spark.createDataFrame([("pt", w, 1) for w in words], "lang string, word string, n int")
    plain = [w.replace("ção", "cao") for w in words]
    rows = spark.createDataFrame([(k, "pt", w.capitalize() + " " + w) for k, w in enumerate(plain)] + [(90, "pt", plain[0].capitalize() + " " + plain[0]), (91, "en", plain[0]), (92, "pt", None)], "id int, lang string, text string")

    def refused(*_):
        raise AssertionError("broadcast")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", refused)
    got = {r.id: r.text for r in clean.restore_accents(rows, dictionary, "text", "lang", F.lit(True), most_rows=10).collect()}
    assert got == {k: w.capitalize() + " " + w for k, w in enumerate(words)} | {90: words[0].capitalize() + " " + words[0], 91: plain[0], 92: None}
