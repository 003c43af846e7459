"""Scalar text functions: columns in, columns out, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillsieve.functions import lexicons as L

_MARKED, _PLAIN = L.accent_folds()
_WIDE, _SINGLE = L.single_capitals()


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` worked out once, however often ``f`` names it: as a lambda's argument it is a value."""
    return F.transform(F.array(x), f)[0]


def _lits(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def blank_to_null(text: Column | str) -> Column:
    """A trimmed text, or null where nothing is left."""
    return F.nullif(F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", ""), F.lit(""))


def stripped(text: Column) -> Column:
    """The text without white space at its ends; only a text that has some there is searched for it."""
    ends = lambda t: F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1)))
    return once(text, lambda t: F.when(ends(t).rlike(r"(?U)\s"), F.regexp_replace(t, r"(?U)^\s+|\s+$", "")).otherwise(t))


def capital(x: Column) -> Column:
    """A text with its first character in upper case, always as one character: ß becomes ẞ, not SS."""
    first = F.substring(x, 1, 1)
    return F.concat(F.when(first.isin(*_WIDE), F.translate(first, _WIDE, _SINGLE)).otherwise(F.upper(first)), F.substring(x, 2, 2147483647))


# words


def words(text: Column | str) -> Column:
    """Words of letters, joined inside by apostrophes or hyphens."""
    return F.regexp_extract_all(_col(text), F.lit(L.JVM_WORD), F.lit(0))


def lower_words(text: Column | str) -> Column:
    return F.transform(words(text), F.lower)


def normalized_text(text: Column | str) -> Column:
    """Lower-cased words with single spaces: what exact duplicates share."""
    return F.array_join(lower_words(text), " ")


def exact_hash(text: Column | str) -> Column:
    return F.sha2(normalized_text(text), 256)


def fold(text: Column | str) -> Column:
    """Lower case without accents."""
    return F.regexp_replace(F.translate(F.lower(_col(text)), _MARKED, _PLAIN), r"\p{Mn}", "")


def joined_keys(text: Column | str) -> Column:
    """The ``word_keys`` in one string with single spaces, folded at once."""
    return fold(F.array_join(words(text), " "))


def word_keys(text: Column | str) -> Column:
    return F.transform(words(text), fold)


# languages


def normalize_language(code: Column | str) -> Column:
    """The part of a language code before its region; blank and null are English."""
    lowered = F.replace(F.lower(F.trim(_col(code))), F.lit("_"), F.lit("-"))
    return F.coalesce(F.nullif(F.split_part(lowered, F.lit("-"), F.lit(1)), F.lit("")), F.lit("en"))


def fillers(language: Column | str) -> Column:
    """The hesitations of a language; unknown ones take the English list."""
    lang, found = _col(language), _lits(L.FILLERS["en"])
    for name, listed in L.FILLERS.items():
        found = F.when(lang == name, _lits(listed)).otherwise(found)
    return found


# Frequent function words by language; a word of several languages counts for each.
FUNCTION_WORDS = {
    "en": "the and of to in is that it was for on with as be at by this are from or an have not you he she they we but his her which there what were when who will if so all would their been more about into than them can only other its our out up some time these two may then do any my now such like",
    "pt": "o a os as que e de do da dos das em no na nos nas um uma uns umas para por com não se é mais como mas foi ao ele ela eles elas seu sua ou quando muito há já está eu também só pelo pela até isso entre era depois sem mesmo aos ter seus quem me esse você essa num nem suas meu às minha têm numa",
    "es": "el la los las que y de del en un una unos unas para por con no se es más como pero fue al él ella ellos su sus o cuando muy hay ya está yo también sólo hasta eso entre era después sin mismo tener quien me ese esa ni mi lo le les este esta porque donde desde todo nos",
    "fr": "le la les des est une un que et de du dans pour pas qui sur au aux avec ce il elle ils elles se sont par plus ne je vous nous on mais ou son sa ses leur leurs cette ces comme tout été même aussi y en d l c qu n s très sans peut fait être avoir entre où",
    "de": "der die das und ist nicht ein eine zu den dem des mit von im in sich auf für auch es an werden aus er hat dass daß sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man kann ich wir ihr sein wurde",
}


def function_word_language(text: Column | str, fallback: Column | str, least: int = 5) -> Column:
    """The language of most function words among the text's tokens; the fallback for fewer than ``least`` tokens or no hit.

    Of equal counts the fallback wins if it is among them, else the first listed language:
    the same text always has the same language. Tokens stand between white space; marks at
    their ends don't count. An expression of the JVM, work per row.
    """
    bare = F.regexp_replace(F.lower(_col(text)), r"(?U)(?=[^\p{L}\s])(?:(?<!\S)[^\p{L}\s]++|(?<![^\p{L}\s])[^\p{L}\s]++(?!\S))", "")
    listed = {name: v.split() for name, v in FUNCTION_WORDS.items()}
    known = F.filter(F.split(bare, r"(?U)\s+", -1), lambda w: w.isin(*sorted({w for v in listed.values() for w in v})))
    best = once(known, lambda b: F.array_max(F.array(*[
        F.struct(F.size(F.filter(b, lambda w: w.isin(*v))).alias("n"), (_col(fallback) == name).alias("own"), F.lit(-k).alias("k"), F.lit(name).alias("l")) for k, (name, v) in enumerate(listed.items())
    ])))
    enough = _col(text).rlike(rf"(?U)(?:\S++\s*+){{{least}}}")
    return once(best, lambda b: F.when(~enough | (b["n"] == 0), _col(fallback)).otherwise(b["l"]))


# cleaning


def timestamp_count_and_text(text: Column | str) -> tuple[Column, Column]:
    """How many time marks go, and the text without them; each pattern sees what the one before left."""
    held = F.when(~_col(text).rlike(r"(?U):\d\d"), "").otherwise(_col(text))  # nothing else holds a mark
    rest, removed = held, F.lit(0)
    for pattern in L.TIMESTAMPS:
        found = F.lit(r"(?U)" + pattern)
        removed = removed + F.regexp_count(rest, found)
        rest = F.regexp_replace(rest, found, F.lit(" "))
    return removed, F.when(held == "", _col(text)).otherwise(rest)


def _is_nonverbal(word: Column) -> Column:
    hit = word.isin(*L.NONVERBAL_EXACT)
    return hit | word.rlike("^(" + "|".join(L.NONVERBAL_STEMS) + ")")


def is_stage_direction(inner: Column) -> Column:
    """Up to six words, all of them sounds, actions or their modifiers, at least one no modifier; no digit."""
    keys = word_keys(inner)
    return (
        ~inner.rlike(r"\p{Nd}")
        & F.size(keys).between(1, 6)
        & F.exists(keys, _is_nonverbal)
        & F.forall(keys, lambda w: _is_nonverbal(w) | w.isin(*L.STAGE_MODIFIERS))
    )


def replaced_at_all_levels(text: Column, pattern: str, into: str, opening: str, unrolled: int = 8) -> Column:
    """Replaces matches until none is left, innermost first.

    The first ``unrolled`` levels are plain expressions. A text that is nested deeper goes on,
    as often as the mark ``opening``, of which a match takes one at least, is left in it.
    """
    for _ in range(unrolled):
        text = F.regexp_replace(text, pattern, into)
    left = lambda t: F.sequence(F.lit(1), F.regexp_count(t, F.lit(opening)))
    deeper = lambda t: F.aggregate(left(t), t, lambda x, _: F.regexp_replace(x, pattern, into))
    return F.transform(F.array(text), lambda t: F.when(t.rlike(pattern), deeper(t)).otherwise(t))[0]


def remove_nonverbal(text: Column | str) -> Column:
    """Square brackets at any depth, music notes, and round or curly brackets around stage directions, each as a space."""
    bracketed = lambda p: (F.length(p) > 2) & p.rlike(r"^[({]")

    def without_directions(t: Column) -> Column:
        parts = F.regexp_extract_all(t, F.lit(r"\([^()]*\)|\{[^{}]*\}|[^(){}]+|[(){}]"), F.lit(0))
        return F.array_join(
            F.transform(parts, lambda p: F.when(bracketed(p) & is_stage_direction(F.substring(p, F.lit(2), F.length(p) - 2)), " ").otherwise(p)), ""
        )

    # each rule is worked out for texts that hold its mark
    squared = lambda t: F.when(t.contains("["), replaced_at_all_levels(t, r"\[[^\[\]]*\]", " ", r"\[")).otherwise(t)
    noted = lambda t: F.when(t.contains("♪"), F.replace(F.regexp_replace(t, "♪[^♪]*♪", " "), F.lit("♪"), F.lit(" "))).otherwise(t)
    return once(once(once(_col(text), squared), noted), lambda t: F.when(t.rlike(r"[({]"), without_directions(t)).otherwise(t))


def filler_count(word_array: Column | str, language: Column | str) -> Column:
    def counted(words_: Column) -> Column:
        # the language is looked at once for all words
        of = lambda listed: F.size(F.filter(words_, lambda w: F.lower(w).isin(*listed)))
        found = of(L.FILLERS["en"])
        for name, listed in L.FILLERS.items():
            found = F.when(_col(language) == name, of(listed)).otherwise(found)
        return found

    return once(_col(word_array), counted)


def remove_fillers(text: Column | str, language: Column | str) -> Column:
    """Hesitation words go, what stands around them stays."""
    listed = fillers(language)
    parts = F.regexp_extract_all(_col(text), F.lit(L.JVM_WORD_OR_GAP), F.lit(0))
    return F.array_join(F.filter(parts, lambda p: ~F.array_contains(listed, F.lower(p))), "")


# of texts in single spaces: words that come again are found first, then none of them may end a sentence
_OPEN = r"""(?![^ ]*[.!?]["'”’)\]]*+(?![^ ]))[^ ]++"""
_RUNS = r"(?iu)(?<![^ ])(?:" + "|".join(
    rf"(?=({w}) \{k}(?![^ ]))({o})(?: \{k}(?![^ ]))++" for k, w, o in ((k, " ".join(["[^ ]++"] * n), " ".join([_OPEN] * n)) for k, n in ((1, 3), (3, 2), (5, 1)))
) + ")"


def single_spaced(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"(?U) \s+|[\s&&[^ ]]\s*", " "))


def gaps(text: Column | str) -> Column:
    return F.length(_col(text)) - F.length(F.replace(_col(text), F.lit(" "), F.lit("")))


def fold_runs(spaced: Column | str) -> Column:
    """Runs of a repeated word, pair or triple become one; not across a sentence end, where a repetition is speech and no slip."""
    return F.regexp_replace(_col(spaced), _RUNS, "$2$4$6")


def collapse_repetitions(text: Column | str) -> tuple[Column, Column]:
    """The text in single spaces with its runs folded, and how many words went."""
    spaced = single_spaced(text)
    folded = fold_runs(spaced)
    return F.when(spaced == "", _col(text)).otherwise(folded), gaps(spaced) - gaps(folded)


def strip_orphan_commas(text: Column | str) -> Column:
    """Commas stay between two letters or digits only, white space aside; runs of commas count as one."""
    t = F.regexp_replace(_col(text), r"(?U),(?:\s*+,)++", ",")
    t = F.regexp_replace(t, r"(?U),\s*([.;:!?])", "$1")

    def glued(parts: Column) -> Column:
        before = F.transform(parts, lambda p: p.rlike(rf"(?U){L.ALNUM}\s*$"))
        after = F.transform(parts, lambda p: p.rlike(rf"(?U)^\s*{L.ALNUM}"))
        # each side is worked out once for all commas and zipped: a lambda would work out what it refers to again for each
        sides = F.arrays_zip(parts.alias("p"), F.array_prepend(before, False).alias("b"), after.alias("a"))
        glue = lambda s, k: F.when((k > 0) & s["b"] & s["a"], F.concat(F.lit(","), s["p"])).otherwise(s["p"])
        return F.array_join(F.transform(F.slice(sides, F.lit(1), F.size(parts)), glue), "")

    return once(t, lambda x: F.when(x.contains(","), once(F.split(x, ",", -1), glued)).otherwise(x))


def residual_commas(text: Column | str) -> Column:
    count = lambda t: F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))
    return count(_col(text)) - once(strip_orphan_commas(text), count)


def normalize_sentences(text: Column | str) -> Column:
    """White space, ellipses and stranded marks in order, a space after each mark, capitals at sentence starts, a final stop."""
    t = F.replace(_col(text), F.lit(" "), F.lit(" "))
    # most texts lack what the first rules look for, which is told faster than a rule is worked out
    for held, pattern, new in (
        (lambda x: x.contains(".."), r"\.{2,}", "..."),
        (lambda x: x.contains("  ") | x.contains("\t"), r" [ \t]+|\t[ \t]*", " "),
        (lambda x: x.rlike(r"(?U)\s[.!?]"), r"(?U)([.!?])\s+[.!?]+(?=\s|$)", "$1"),
        (lambda x: x.contains("\n\n\n"), r"\n{3,}", "\n\n"),
        (lambda x: x.rlike(r"(?U)\s[,.;:!?]"), r"(?U)\s+([,.;:!?])", "$1"),
    ):
        t = once(t, lambda x: F.when(held(x), F.regexp_replace(x, pattern, new)).otherwise(x))  # noqa: B023  called at once
    t = stripped(F.regexp_replace(t, r"(?U)([.!?])([^\s\d])", "$1 $2"))
    t = F.regexp_replace(t, r"(?U)([.!?]+)\s+", "\u0001$1\u0001")
    ends = lambda p: p.endswith(".") | p.endswith("!") | p.endswith("?")
    parts = F.transform(F.split(t, "\u0001", -1), lambda p, k: F.when(k % 2 == 0, capital(stripped(p))).otherwise(p))
    parts = F.filter(parts, lambda p: p != "")
    glued = F.array_join(F.transform(parts, lambda p, k: F.when((k == 0) | (F.left(p, F.lit(1)).isin(".", "!", "?") & p.rlike(r"^[.!?]+$")), p).otherwise(F.concat(F.lit(" "), p))), "")
    return once(glued, lambda g: F.when((g == "") | ends(g), g).otherwise(F.concat(g, F.lit("."))))


# sentences


def split_sentences(text: Column | str) -> Column:
    """Cut after a mark and white space; blank pieces go."""
    parts = F.split(F.regexp_replace(_col(text), r"(?U)([.!?])\s+", "$1\u0001"), "\u0001", -1)
    return F.filter(F.transform(parts, stripped), lambda p: p != "")


def sentence_words(text: Column | str) -> Column:
    """The words of each piece between marks, pieces without words left out."""
    return F.filter(F.transform(F.split(_col(text), "[.!?]+", -1), words), lambda w: F.size(w) > 0)


def syllables(word: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(word, F.lit(L.VOWELS)))


def needs_punctuation(text: Column | str) -> Column:
    """At least 20 words with fewer than 2 sentence marks in a hundred words."""
    return once(F.regexp_count(_col(text), F.lit(L.JVM_WORD)), lambda n: (n >= 20) & (F.regexp_count(_col(text), F.lit("[.!?]")) < 0.02 * n))


# links, durations, names


# Link and duration patterns.
_LINK = r"https?://(?:www\.)?(?:youtube\.com|youtu\.be)/[^\s]+"
_VIDEO = (r"(?:youtube\.com/watch\?v=|youtu\.be/|youtube\.com/embed/)([^&\n?#]+)", r"youtube\.com/v/([^&\n?#]+)")
_PLAYLIST = r"(?:youtube\.com/playlist\?list=|youtube\.com/watch\?.*&list=)([^&\n?#]+)"
_CHANNEL = r"/channel/|/c/|/user/|(?i:youtube\.com/@)"
_DURATION = r"PT(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+)S)?"


def detect_urls(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(_LINK), F.lit(0))


def video_id(url: Column | str) -> Column:
    """The id of a video link, or null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(_col(url), p, 1), F.lit("")) for p in _VIDEO])


def playlist_id(url: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(url), _PLAYLIST, 1), F.lit(""))


def url_kind(urls: Column | str) -> Column:
    """What a list of links asks for: a playlist, a channel, one video or several; null for none."""
    u = _col(urls)
    return (
        F.when(F.size(u) == 0, F.lit(None).cast("string"))
        .when(F.exists(u, lambda x: x.contains("playlist")), "playlist")
        .when(F.exists(u, lambda x: x.rlike(_CHANNEL)), "channel")
        .when(F.size(u) == 1, "video")
        .otherwise("mixed")
    )


def iso_duration_seconds(text: Column | str) -> Column:
    """Seconds of the first PT#H#M#S; anything else is 0, and days do not count."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(_col(text), _DURATION, k), F.lit("")).cast("long"), F.lit(0))
    return part(1) * 3600 + part(2) * 60 + part(3)


def format_duration(seconds: Column | str) -> Column:
    """1h 2m, 3m 4s, 3m or 5s; a dash for null and what is not positive."""
    s = _col(seconds)
    whole = F.floor(s).cast("long")
    h, m, rest = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    return (
        F.when(s.isNull() | (s <= 0), "—")
        .when(h > 0, F.concat(h, F.lit("h "), m, F.lit("m")))
        .when((m > 0) & (rest > 0), F.concat(m, F.lit("m "), rest, F.lit("s")))
        .when(m > 0, F.concat(m, F.lit("m")))
        .otherwise(F.concat(rest, F.lit("s")))
    )


def name_from_email(email: Column | str) -> Column:
    """Capitalised parts of the local part, cut at its dots, else its underscores, else its hyphens; User for none."""
    local = F.split_part(_col(email), F.lit("@"), F.lit(1))
    named = lambda p: capital(F.lower(p))
    name = named(local)
    for mark in ("-", "_", "."):  # the last to be wrapped is the first to be tried
        parts = F.array_join(F.transform(F.filter(F.split(local, "[" + mark + "]", -1), lambda p: p != ""), named), " ")
        name = F.when(local.contains(mark) & (parts != ""), parts).otherwise(name)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("User"))


# model replies


def json_object(raw: Column | str) -> Column:
    """The JSON object in a model's reply: a fenced one, else from the first brace to the last; null if it is none."""
    t = F.trim(F.coalesce(_col(raw), F.lit("")))
    fenced = F.nullif(F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    braced = F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit(""))
    return once(F.coalesce(fenced, braced), lambda found: F.when(F.try_parse_json(found).isNotNull(), found))


def score(value: Column) -> Column:
    """A finite number within 0 and 10 at two places, else null."""

    def bounded(x: Column) -> Column:
        finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
        return F.when(finite, F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), x)), 2))

    return once(value.try_cast("double"), bounded)


def normalize_winner(label: Column | str) -> Column:
    t = F.regexp_replace(F.lower(F.trim(_col(label))), r"^version[\s_\-]*", "")
    t = F.regexp_replace(t, r"""^[ .!"']+|[ .!"']+$""", "")
    return F.when(t == "a", "A").when(t == "b", "B").otherwise("tie")


def resolve_swapped(first: Column | str, second: Column | str) -> tuple[Column, Column]:
    """(outcome, position-consistent) of the two orders of one comparison."""
    same = _col(first) == _col(second)
    return F.when(same, _col(first)).otherwise("tie"), same


def strip_tags(text: Column | str, tags: tuple[str, ...]) -> Column:
    """Opening and closing tags go, those that appear once others are gone as well."""
    return replaced_at_all_levels(_col(text), r"(?iU)<\s*/?\s*(?:" + "|".join(tags) + r")\s*>", "", "<")


def wrap_excerpt(text: Column | str, tag: str = "transcript") -> Column:
    return F.concat(F.lit(f"<{tag}>\n"), strip_tags(text, (tag,)), F.lit(f"\n</{tag}>"))


def excerpt_pair(raw: Column | str, processed: Column | str, most: int = 180) -> tuple[Column, Column]:
    """The first ``most`` words of a raw text, and as large a part of the processed one."""
    cut = lambda t: F.filter(F.split(_col(t), r"(?U)\s+", -1), lambda w: w != "")
    a, b = cut(raw), cut(processed)
    n = F.greatest(F.lit(1), F.bround(most * F.size(b) / F.greatest(F.lit(1), F.size(a))).cast("int"))
    return F.array_join(F.slice(a, 1, most), " "), F.array_join(F.slice(b, F.lit(1), n), " ")


def user_prompt(title: Column | str, language: Column | str, chunk: Column, chunks: Column, text: Column | str) -> Column:
    """What is known of an excerpt, a blank line, and the excerpt in its tags."""
    part = F.when(chunks > 1, F.concat(F.lit("Chunk: "), chunk, F.lit("/"), chunks))
    line = lambda name, value: F.when(_col(value) != "", F.concat(F.lit(f"{name}: "), _col(value)))
    head = F.concat_ws("\n", line("Title", title), line("Language", language), part)
    return F.concat(F.when(head == "", "").otherwise(F.concat(head, F.lit("\n\n"))), wrap_excerpt(text))


def wrap_pair(a: Column | str, b: Column | str) -> Column:
    """Two versions in their tags, without such tags inside."""
    one, two = (strip_tags(x, ("version_a", "version_b")) for x in (a, b))
    return F.concat(F.lit("<version_a>\n"), one, F.lit("\n</version_a>\n<version_b>\n"), two, F.lit("\n</version_b>"))
