"""Quality rules: simple text counts, and perplexity bands of a modified Kneser-Ney model of code points for each language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillsieve.llm.common import checkpointed, materialised
from quillsieve.llm.toxicity import held_out

#: A gram is four code points: the first as a number, the other three in one of 63 bits. The place before a text is code point 0.
ORDER, BITS = 4, 21
_M1, _M2 = (1 << BITS) - 1, (1 << 2 * BITS) - 1


def text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(first, rest) of the gram that ends at each character of all texts, one after the other."""
    first, rest = [], []
    for t in texts:
        p = np.concatenate((np.zeros(ORDER - 1, np.int64), np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)))
        n = len(p) - ORDER + 1
        first.append(p[:n])
        rest.append(p[1 : n + 1] << 2 * BITS | p[2 : n + 2] << BITS | p[3 : n + 3])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *first]), np.concatenate([none, *rest])


def gram_hash(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """64 bits by which the model's arrays are sorted."""
    h = (rest.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29)) ^ first.view(np.uint64)) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null is an empty one."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    chars = len(text or "") - (len(raw) - sum(map(len, words)))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return n, chars, symbols, len(lines) - len(set(lines)), _repeat_words(words)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _repeat_words(words: list[bytes], window: int = 8) -> int:
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, n)
    m = n - window + 1
    h = np.zeros(m, np.uint64)
    for k in range(window):
        h = (h + ids[k : k + m] + np.uint64(1)) * _STEP
        h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    several = np.concatenate((same, [False])) | np.concatenate(([False], same))
    first: dict[tuple, int] = {}
    covered = np.zeros(n + 1, np.int64)
    for k in np.sort(order[several]).tolist():  # equal hashes are compared word by word
        key = tuple(ids[k : k + window].tolist())
        if key in first:
            for a in (k, first[key]):
                covered[a] += 1
                covered[a + window] -= 1
        else:
            first[key] = k
    return int((np.cumsum(covered)[:n] > 0).sum())


def _blocks(texts: list[str], most: int = 1_000_000) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def _distinct(first: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams, the place of each given one among them, and how often each stands."""
    h = gram_hash(first, rest)
    _, at, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    return first[at], rest[at], back, n


#: Parts of each language's grams that are summed apart, and grams of a language that a task holds before it sends them on.
_PARTS, _MOST_HELD = 256, 2_000_000


def _summed(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams (first, rest) of blocks with counts, and their counts."""
    first, rest, n = (np.concatenate(x) for x in zip(*blocks, strict=True))
    first, rest, back, _ = _distinct(first, rest)
    counts = np.zeros(len(first), np.int64)
    np.add.at(counts, back, n)
    return first, rest, counts


def packed_grams(first: np.ndarray, rest: np.ndarray, n: np.ndarray) -> bytes:
    """Grams with counts in a few bytes each: sorted, as differences, equal bytes of all numbers side by side, compressed."""
    order = np.lexsort((rest, first))
    columns = [np.diff(first[order], prepend=0), np.diff(rest[order], prepend=0), n[order]]
    planes = b"".join(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return len(first).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked_grams(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 24 * size, codec="zstd", asbytes=True), np.uint8).reshape(3, 8, size)
    first, rest, n = (np.ascontiguousarray(p.T).view("<i8").ravel() for p in planes)
    return np.cumsum(first), np.cumsum(rest), n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, part, grams): the packed grams of a task's texts, a row for each language and part; a three-gram's contexts are all in one part."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def sent(lang: str) -> Iterator[pa.RecordBatch]:
        first, rest, n = _summed(held.pop(lang))
        part = (gram_hash(np.zeros(len(rest), np.int64), rest) % np.uint64(_PARTS)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        first, rest, n, part = first[order], rest[order], n[order], part[order]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        rows = [packed_grams(first[a:b], rest[a:b], n[a:b]) for a, b in zip(starts, [*starts[1:], len(part)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(part[starts].astype(np.int32)), pa.array(rows, pa.binary())], ["lang", "part", "grams"])

    for batch in batches:
        texts: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            for block in _blocks(own):
                first, rest, _, n = _distinct(*text_grams(block))
                held.setdefault(lang, []).append((first, rest, n))
                if sum(len(x[0]) for x in held[lang]) > _MOST_HELD:
                    held[lang] = [_summed(held[lang])]
                    if len(held[lang][0][0]) > _MOST_HELD // 2:
                        yield from sent(lang)
    for lang in list(held):
        yield from sent(lang)


def _merged(rows: pa.Table) -> pa.Table:
    """The grams of one language and part, each once with its count over all tasks."""
    first, rest, n = _summed([unpacked_grams(x) for x in rows.column("grams").to_pylist()])
    return pa.table({"lang": pa.array([rows.column("lang")[0].as_py()] * len(n), pa.string()), "first": pa.array(first.astype(np.int32)), "rest": pa.array(rest), "c": pa.array(n)})


def _discounts(grams: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): what counts of 1, 2 and 3 or more lose, from the counts of counts of each language; fixed where those are too few to tell."""
    n = {k: F.count_if(F.col("c") == k).cast("double") for k in (1, 2, 3, 4)}
    c = grams.groupBy("lang").agg(*[v.alias(f"n{k}") for k, v in n.items()])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    known = F.least("n1", "n2", "n3", "n4") > 0
    one = lambda k: F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(float(k)), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")))).otherwise(0.5 * k)
    return c.select("lang", *[one(k).alias(f"d{k}") for k in (1, 2, 3)])


def _smoothed(grams: DataFrame, context: Column, lower: DataFrame, suffix: Column) -> tuple[DataFrame, DataFrame]:
    """``grams`` (lang, ..., c) with ``p``, discounted counts of the context and what they lose by the order below (lang, key, p); and (lang, context, v), what each context loses."""
    c = F.col("c")
    lost = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = grams.join(F.broadcast(_discounts(grams)), "lang").withColumns({"context": context, "suffix": suffix, "lost": lost})  # a row for each language
    totals = checkpointed(rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("lost").alias("given")))
    lower = lower.select("lang", F.col("key").alias("suffix"), F.col("p").alias("below"))
    rows = rows.join(totals, ["lang", "context"]).join(lower, ["lang", "suffix"])
    rows = rows.withColumn("p", (c - F.col("lost") + F.col("given") * F.col("below")) / F.col("total")).select(*grams.columns, "p")
    return rows, totals.select("lang", "context", (F.col("given") / F.col("total")).alias("v"))


def kneser_ney(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, first, rest, v): the interpolated modified Kneser-Ney model of each language.

    Of a gram of n code points ``v`` is the probability of the last after the others, of a
    context what is left for grams that it lacks; ``first`` also holds n, or n + 10 for
    contexts. Grams of all ``docs`` are counted on Spark; the orders below count in how many
    contexts a gram stands. A null language is one of its own. Every language has a model,
    whatever their number; nothing comes to the driver.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    packed = rows.mapInArrow(_counted, "lang string, part int, grams binary")
    four = checkpointed(packed.groupBy("lang", "part").applyInArrow(_merged, "lang string, first int, rest long, c long"))
    three = checkpointed(four.groupBy("lang", F.col("rest").alias("key")).agg(F.count("*").alias("c")))
    two = three.groupBy("lang", F.col("key").bitwiseAND(F.lit(_M2)).alias("key")).agg(F.count("*").alias("c"))
    one = two.groupBy("lang", F.col("key").bitwiseAND(F.lit(_M1)).alias("key")).agg(F.count("*").alias("c"))
    none = one.groupBy("lang").agg((1 / (F.count("*") + 1)).alias("p")).withColumn("key", F.lit(0).cast("long"))
    key, zero = F.col("key"), F.lit(0).cast("long")
    p1, left1 = _smoothed(one, zero, none, zero)
    p2, left2 = _smoothed(two, F.shiftright(key, BITS), p1, key.bitwiseAND(F.lit(_M1)))
    p3, left3 = _smoothed(three, F.shiftright(key, BITS), p2, key.bitwiseAND(F.lit(_M2)))
    p3 = checkpointed(p3)
    p4, left4 = _smoothed(four, F.struct("first", F.shiftright("rest", BITS).alias("rest")), p3, F.col("rest"))
    row = lambda df, n, v, first=F.lit(0), rest=key: df.select("lang", (first.cast("long") + (n << 32)).alias("first"), rest.alias("rest"), v.alias("v"))
    context = F.col("context")
    model = row(p4, 4, F.col("p"), F.col("first"), F.col("rest"))
    for n, grams in ((3, p3), (2, p2), (1, p1), (0, none)):
        model = model.unionByName(row(grams, n, F.col("p")))
    model = model.unionByName(row(left4, 14, F.col("v"), context["first"], context["rest"]))
    for n, left in ((3, left3), (2, left2), (1, left1)):
        model = model.unionByName(row(left, n + 10, F.col("v"), rest=context))
    return model


class SortedModel:
    """The log values of one language's grams and contexts under their sorted hashes."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order].astype(np.float64)

    def get(self, kind: int, first: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its value or 0."""
        h = gram_hash(first + (kind << 32), rest)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        found = self.hashes[at] == h
        return found, np.where(found, self.values[at], 0.0)

    def log_prob(self, first: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Of the last code point of each gram after the others; of grams that are not there, by the orders below."""
        out, open_ = np.zeros(len(rest)), np.arange(len(rest))
        if not len(self.hashes):
            return out
        none = np.zeros(len(rest), np.int64)
        for n in range(ORDER, 0, -1):
            head = first if n == ORDER else none
            own = rest & ((1 << BITS * min(n, 3)) - 1)
            found, value = self.get(n, head[open_], own[open_])
            out[open_[found]] += value[found]
            open_ = open_[~found]
            if not len(open_):
                return out
            out[open_] += self.get(n + 10, head[open_], own[open_] >> BITS)[1]
        out[open_] += self.get(0, none[open_], none[open_])[1]
        return out

    def losses(self, texts: list[str]) -> np.ndarray:
        """Mean loss of each text over its code points; NaN for an empty one."""
        out = np.full(len(texts), np.nan)
        first = 0
        for block in _blocks(texts):
            sizes = np.array([len(t) for t in block])
            a, b, back, _ = _distinct(*text_grams(block))
            sums = np.concatenate(([0.0], np.cumsum(self.log_prob(a, b)[back])))
            ends = np.cumsum(sizes)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[first : first + len(block)] = -(sums[ends] - sums[ends - sizes]) / sizes
            first += len(block)
        return out


def _model_arrays(rows: pa.Table) -> pa.Table:
    """Rows of one language and bucket as one row of sorted arrays."""
    h = gram_hash(rows.column("first").to_numpy(), rows.column("rest").to_numpy())
    order = np.argsort(h)
    values = np.log(np.maximum(rows.column("v").to_numpy()[order], 1e-30)).astype(np.float32)
    return pa.table({"lang": rows.column("lang")[:1], "hashes": pa.array([h[order].tobytes()], pa.binary()), "values": pa.array([values.tobytes()], pa.binary())})


def _join_arrays(rows: list[tuple[bytes, bytes]]) -> SortedModel:
    return SortedModel(np.concatenate([np.frombuffer(h, np.uint64) for h, _ in rows]), np.concatenate([np.frombuffer(v, np.float32) for _, v in rows]))


_SCORED = "model string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, loss double"


def _scores(ids: pa.Array, langs: list[str], texts: list[str | None], models) -> pa.RecordBatch:
    loss = np.full(len(texts), np.nan)
    for lang in set(langs):
        rows = [k for k, x in enumerate(langs) if x == lang and texts[k]]
        if rows:
            loss[rows] = (models.get(lang) or models[None]).losses([texts[k] for k in rows])
    base = np.array([base_counts(t) for t in texts], np.int64).reshape(len(texts), 5)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(langs, pa.string()), *(pa.array(base[:, k]) for k in range(5)), pa.array(loss, mask=np.isnan(loss))],
        ["id", "model", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "loss"],
    )


def _streamed(batches: Iterator[pa.RecordBatch], ident: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Scores rows sorted by (lang, salt, kind): of each pair the model's arrays come first, then the texts."""
    held: tuple | None = None
    arrays: list[tuple[bytes, bytes]] = []
    model: SortedModel | None = None
    for batch in batches:
        ids: list = []
        texts: list = []
        for row in batch.to_pylist():
            if (row["lang"], row["salt"]) != held:
                if ids:
                    yield _scores(pa.array(ids, ident), [held[0]] * len(ids), texts, {None: model})
                    ids, texts = [], []
                held, arrays, model = (row["lang"], row["salt"]), [], None
            if row["kind"] == 0:
                arrays.append((row["hashes"], row["values"]))
                continue
            if model is None:
                model, arrays = _join_arrays([(b"", b""), *arrays]), []
            ids.append(row["id"])
            texts.append(row["text"])
        if ids:
            yield _scores(pa.array(ids, ident), [held[0]] * len(ids), texts, {None: model})


def scored_texts(docs: DataFrame, model: DataFrame, id_col: str, text_col: str, lang_col: str, most_broadcast: int = 4_000_000, task_chars: int = 32_000_000, bucket: int = 500_000) -> DataFrame:
    """(id, model, base counts, loss) of every document by its language's rows of ``model``, the table of ``kneser_ney``.

    The models are rows of sorted arrays. Up to ``most_broadcast`` grams (12 bytes each) in
    all, after a count, they are broadcast; beyond that the texts are dealt out by language
    and salt, about ``task_chars`` of one language to a part, and each part gets its
    language's arrays first and then streams its texts.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    ident = rows.schema["id"].dataType
    size = model.count()
    buckets = model.withColumn("bucket", F.pmod(F.xxhash64("first", "rest"), F.lit(size // bucket + 1)))
    arrays = buckets.groupBy("lang", "bucket").applyInArrow(_model_arrays, "lang string, hashes binary, values binary")
    if size <= most_broadcast:
        found: dict[str, list[tuple[bytes, bytes]]] = {}
        for r in arrays.collect():
            found.setdefault(r.lang, []).append((bytes(r.hashes), bytes(r["values"])))
        none = {None: SortedModel(np.zeros(0, np.uint64), np.zeros(0))}
        shared = docs.sparkSession.sparkContext.broadcast(none | {lang: _join_arrays(own) for lang, own in found.items()})

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 1000):
                    some = batch.slice(k, 1000)
                    yield _scores(some.column("id"), some.column("lang").to_pylist(), some.column("text").to_pylist(), shared.value)

        return rows.mapInArrow(scored, f"id {ident.simpleString()}, {_SCORED}")
    parts = rows.groupBy("lang").agg(F.floor(F.coalesce(F.sum(F.length("text")), F.lit(0)) / task_chars + 1).cast("int").alias("salts"))
    salted = rows.join(parts, "lang").withColumn("salt", F.pmod(F.xxhash64("id", "text"), F.col("salts")).cast("int"))
    texts = salted.select("lang", "salt", F.lit(1).alias("kind"), "id", "text", F.lit(None).cast("binary").alias("hashes"), F.lit(None).cast("binary").alias("values"))
    copies = arrays.join(parts, "lang").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    copies = copies.select("lang", "salt", F.lit(0).alias("kind"), F.lit(None).cast(ident).alias("id"), F.lit(None).cast("string").alias("text"), "hashes", "values")
    dealt = texts.unionByName(copies).repartition("lang", "salt").sortWithinPartitions("lang", "salt", "kind")
    arrow = to_arrow_type(ident)
    return dealt.mapInArrow(lambda b: _streamed(b, arrow), f"id {ident.simpleString()}, {_SCORED}")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], digits: int = 3) -> DataFrame:
    """(keys, q): for each share the least value, rounded to ``digits``, that so many of a key's rows don't exceed; from counts, so the same on any partitioning."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.round(value, digits).alias("_v")).agg(F.count("*").alias("_n"))
    up = Window.partitionBy(*keys).orderBy("_v")
    whole = Window.partitionBy(*keys)
    summed = counted.withColumns({"_up": F.sum("_n").over(up), "_all": F.sum("_n").over(whole)})
    return summed.groupBy(*keys).agg(F.array(*[F.min(F.when(F.col("_up") >= F.ceil(F.col("_all") * s), F.col("_v"))) for s in shares]).alias("q"))


def rows_among(docs: DataFrame, id_col: str, ids: DataFrame, most_parts: int = 8192) -> DataFrame:
    """The rows of ``docs`` whose id stands in the one column of ``ids``, without a shuffle of their texts.

    Whole-number ids become bits in parts of 32,768 numbers, 4 KB each, that tasks look up:
    exact, and 2 MB for 15 million ids in a row. Ids of other types, and those that lie in more
    than ``most_parts`` parts, are joined.
    """
    own = ids.columns[0]
    whole = {"tinyint", "smallint", "int", "bigint"}
    parts = None
    if dict(docs.dtypes)[id_col] in whole and ids.dtypes[0][1] in whole:
        n = F.col(own).cast("long")
        parts = ids.where(n.isNotNull()).groupBy(F.shiftright(n, 15).alias("part")).agg(F.bitmap_construct_agg(n.bitwiseAND(F.lit(32767))).alias("bits")).limit(most_parts + 1).collect()
    if parts is None or len(parts) > most_parts:
        return docs.join(ids, F.col(id_col) == F.col(own), "left_semi")
    parts.sort(key=lambda r: r.part)
    bits = np.frombuffer(b"".join([*(bytes(r.bits) for r in parts), bytes(4096)]), np.uint8).reshape(-1, 4096)
    shared = docs.sparkSession.sparkContext.broadcast((np.array([r.part for r in parts], np.int64), bits))

    @F.pandas_udf("boolean")
    def among(batch: pd.Series) -> pd.Series:
        numbers = batch.to_numpy()
        known, table = shared.value
        at = np.searchsorted(known, numbers >> 15)
        at[at < len(known)] = np.where(known[at[at < len(known)]] == (numbers >> 15)[at < len(known)], at[at < len(known)], len(known))
        place = numbers & 32767
        return pd.Series((table[at, place >> 3] >> (place & 7) & 1).astype(bool))

    number = F.col(id_col).cast("long")
    return docs.where(number.isNotNull() & among(F.coalesce(number, F.lit(0).cast("long"))))


def quality_rules(
    docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality",
    margin: float = 3.0, keep_good: float = 0.995, least_width: float = 0.02, spread: float = 0.6, **options,
) -> DataFrame:
    """One row per document: id, the base counts, ``base_failed``, ``kept``, ``perplexity`` and its band ``low`` and ``high``.

    A language's model counts the documents that ``labels`` (id, quality) call good, all of
    them but the held-out fifth and a fifth for the bands, and all documents where none is
    (or without labels): junk that a model has counted looks likely to it. A band reaches beyond the quartiles of log perplexity
    of the language's documents that pass the base rule, by a number of their distance
    (``least_width`` at least), and by ``spread`` over the root of the text's characters, as
    the mean of a short text varies more. That number is as large, below and above, as
    ``keep_good`` of the good documents of the bands' fifth need it; without labels it is ``margin``. Null
    texts count as empty: no words, perplexity null, not kept. Null languages are judged by
    their own model. Repeated rows keep a row each; other columns are ignored.
    """
    reference, good = docs, None
    if labels is not None:
        every = labels.where((F.col(label_col) == 1) & ~held_out(id_col)).select(F.col(id_col).alias("_good_id")).distinct()
        for_bands = F.crc32(F.col("_good_id").cast("string").cast("binary")) % 5 == 1
        good, bands_good = every.where(~for_bands), every.where(for_bands)
        lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
        known = docs.select(F.col(id_col).alias("_id"), lang.alias("_lang")).join(good, F.col("_id") == F.col("_good_id"), "left_semi").select("_lang").distinct()
        known = checkpointed(known)  # a row for each language
        reference = rows_among(docs, id_col, good).unionByName(docs.join(F.broadcast(known), lang == F.col("_lang"), "left_anti"))
    model = materialised(kneser_ney(reference, text_col, lang_col))
    scored = checkpointed(scored_texts(docs, model, id_col, text_col, lang_col, **options))
    scored = scored.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    bands = exact_quantiles(scored.where("not base_failed"), ["model"], "loss", [0.25, 0.75])
    q = F.col("q")
    bands = bands.select("model", q[0].alias("q1"), q[1].alias("q3"), F.greatest(q[1] - q[0], F.lit(least_width)).alias("width"))
    found = scored.join(bands, "model", "left")  # a row for each language
    slack = spread / F.sqrt(F.greatest("word_chars", F.lit(1)))
    found = found.withColumns({"below": (F.col("q1") - slack - F.col("loss")) / F.col("width"), "above": (F.col("loss") - F.col("q3") - slack) / F.col("width")})
    reach = [margin, margin]
    if good is not None:
        own = found.where("not base_failed").join(bands_good, F.col("id") == F.col("_good_id"), "left_semi")
        share = 1 - (1 - keep_good) / 2
        for k, side in enumerate(("below", "above")):
            got = exact_quantiles(own.select(side), [], side, [share]).first()
            if got is not None and got.q[0] is not None:
                reach[k] = max(float(got.q[0]), 0.0)
    below, above = reach
    low, high = (F.exp(F.col("q1") - slack - below * F.col("width")), F.exp(F.col("q3") + slack + above * F.col("width")))
    inside = (F.col("below") <= below + 1e-9) & (F.col("above") <= above + 1e-9)
    return found.select(
        F.col("id").alias(id_col),
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
        F.coalesce(~F.col("base_failed") & inside, F.lit(False)).alias("kept"),
        F.exp("loss").alias("perplexity"),
        low.alias("low"),
        high.alias("high"),
    )
