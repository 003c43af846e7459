"""Removal of byte strings that occur earlier in the corpus, by depth-limited radix passes over suffixes.

A repeated window of ``threshold`` bytes is an equal group of suffixes that are ordered
through ``threshold`` bytes only. Ordering every suffix would shuffle the corpus many times
over, so the passes start from suffixes at content-chosen positions (the least hashed
``digit`` bytes of some window): equal windows choose equal positions in themselves, so
none is missed. The digits, most significant first: the chosen ``digit`` bytes, then the
whole context that windows around them can cover, then single windows where contexts
differ. A group of one leaves after each pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import complete_runs, kept_columns, materialised, quoted, text_bytes

_ODD = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NO_ID = -(2**63)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    def run(base: int) -> np.ndarray:
        x = np.full(n, base % 2**64, np.uint64)
        x[0] = 1
        return np.cumprod(x)

    return run(_ODD), run(pow(_ODD, -1, 2**64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _least(x: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """``pick`` over x[i : i + width] for every i where that fits."""
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def chosen_suffixes(raw: np.ndarray, starts: np.ndarray, threshold: int, digit: int) -> dict[str, np.ndarray]:
    """For texts laid end to end in ``raw``: the chosen positions with their first digit and their context.

    ``left`` and ``right`` are the bytes of context before the position and after the digit.
    """
    n, wide = len(raw), threshold - digit + 1
    none = {k: np.zeros(0, np.int64) for k in ("at", "doc", "left", "right", "digit", "context")}
    if n < threshold:
        return none
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:n], out=sums[1:])
    digits = _mixed((sums[digit:] - sums[:-digit]) * down[: n - digit + 1])
    digits |= np.uint64(1)
    ends = np.concatenate((starts[1:], [n]))
    least = _least(digits, wide)
    inside = np.zeros(len(least) + 1, np.int32)
    long_ = ends - starts >= threshold
    np.add.at(inside, starts[long_], 1)
    np.add.at(inside, ends[long_] - threshold + 1, -1)
    least[np.cumsum(inside)[:-1] == 0] = 0
    pad = np.zeros(wide - 1, np.uint64)
    at = np.flatnonzero(_least(np.concatenate((pad, least, pad)), wide, np.maximum) == digits)
    doc = np.searchsorted(starts, at, side="right") - 1
    left = np.minimum(at - starts[doc], threshold - digit)
    right = np.minimum(ends[doc] - at - digit, threshold - digit)
    a, b = at - left, at + digit + right
    context = _mixed((sums[b] - sums[a]) * down[a] + (left * 1024 + right).astype(np.uint64))
    return {"at": at, "doc": doc, "left": left, "right": right, "digit": digits[at].view(np.int64), "context": context.view(np.int64)}


def _united(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of the ranges [a, b) of each doc; overlapping or touching ranges become one."""
    if not len(a):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    shift = (doc - doc[0]) * np.int64(2**32)
    reach = np.maximum.accumulate(b + shift)
    first = np.concatenate(([True], (a + shift)[1:] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(first)[1:] - 1, [len(a) - 1]))
    return doc[first], a[first], (reach - shift)[last]


_SUFFIX = "digit long, context long, id long, tie long, at int, span int"


def _suffixes(batches: Iterator[pa.RecordBatch], threshold: int, digit: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of chosen suffixes. Of those with an equal context in a block only the first goes on;
    the others are repeats already and leave as ranges (span -1) under a digit of their own."""
    for batch in batches:
        ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        raws = batch.column(2)
        sizes = pc.binary_length(raws).to_numpy()
        block, held = [], 0
        for k in range(len(raws)):
            block.append(k)
            held += int(sizes[k])
            if held < most and k + 1 < len(raws):
                continue
            rows = np.array(block)
            size = sizes[rows].astype(np.int64)
            rows, size = rows[size >= threshold], size[size >= threshold]
            block, held = [], 0
            if not len(rows):
                continue
            raw = np.frombuffer(b"".join(raws[int(r)].as_py() for r in rows), np.uint8)
            got = chosen_suffixes(raw, np.cumsum(size) - size, threshold, digit)
            start = (np.cumsum(size) - size)[got["doc"]]
            row, at = rows[got["doc"]], got["at"] - start
            order = np.lexsort((at, ids[row], got["context"], got["digit"]))
            d, c = got["digit"][order], got["context"][order]
            new = np.concatenate(([True], (d[1:] != d[:-1]) | (c[1:] != c[:-1]))) if len(d) else np.zeros(0, bool)
            head = order[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] if len(d) else order
            later = (ids[row[order]] != ids[row[head]]) | (at[order] != at[head])
            go, stay = order[~later], order[later]
            span = got["left"] * 1024 + got["right"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(got["digit"][go]),
                    pa.array(got["context"][go]),
                    pa.array(ids[row[go]]),
                    pa.array(ties[row[go]]),
                    pa.array(at[go].astype(np.int32)),
                    pa.array(span[go].astype(np.int32)),
                ],
                ["digit", "context", "id", "tie", "at", "span"],
            )
            of, a, b = _united(row[stay], (at - got["left"])[stay], (at + digit + got["right"])[stay])
            if len(of):
                route = _mixed(ids[of].view(np.uint64) * np.uint64(31) + a.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(route), pa.array(b), pa.array(ids[of]), pa.array(ties[of]), pa.array(a.astype(np.int32)), pa.array(np.full(len(of), -1, np.int32))],
                    ["digit", "context", "id", "tie", "at", "span"],
                )


_FOUND = "id long, tie long, a int, b int, digit long"


def _found(ids, ties, a, b, digit) -> pa.RecordBatch:
    """Ranges [a, b) that repeat; or, with b = -1, the suffix at ``a`` that needs its windows compared."""
    return pa.RecordBatch.from_arrays(
        [pa.array(ids), pa.array(ties), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(digit)],
        ["id", "tie", "a", "b", "digit"],
    )


def _contexts(batches: Iterator[pa.RecordBatch], digit_bytes: int) -> Iterator[pa.RecordBatch]:
    """The second pass over a stream sorted by digit, context, id, at. Between batches it keeps the first row
    of the running context and whether the running digit has shown several contexts."""
    names = ("digit", "context", "id", "tie", "at", "span")
    head, crowd = None, False
    for batch in batches:
        col = {k: batch.column(k).to_numpy() for k in names}
        ready = col["span"] == -1
        if ready.any():
            yield _found(col["id"][ready], col["tie"][ready], col["at"][ready], col["context"][ready], col["digit"][ready])
            col = {k: x[~ready] for k, x in col.items()}
        if not len(col["id"]):
            continue
        if head is not None:
            col = {k: np.concatenate(([head[k]], x)) for k, x in col.items()}
        d, c, ids, at = col["digit"], col["context"], col["id"], col["at"]
        new_d = np.concatenate(([True], d[1:] != d[:-1]))
        new_c = new_d | np.concatenate(([True], c[1:] != c[:-1]))
        first = np.maximum.accumulate(np.where(new_c, np.arange(len(d)), 0))
        later = (ids != ids[first]) | (at != at[first])
        if later.any():
            left, right = col["span"] // 1024, col["span"] % 1024
            yield _found(ids[later], col["tie"][later], (at - left)[later], (at + digit_bytes + right)[later], d[later])
        group = np.cumsum(new_d) - 1
        several = np.bincount(group, weights=new_c) > 1
        several[0] |= crowd
        ask = ~later & several[group]
        if crowd:  # then the head row was asked for in an earlier batch
            ask[0] = False
        if ask.any():
            yield _found(ids[ask], col["tie"][ask], at[ask], np.full(int(ask.sum()), -1), d[ask])
        head, crowd = {k: x[first[-1]] for k, x in col.items()}, bool(several[-1])


def _cut_contexts(batches: Iterator[pa.RecordBatch], threshold: int, digit: int) -> Iterator[pa.RecordBatch]:
    reach = threshold - digit
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for raw, asked, i, tie in zip(*(batch.column(k).to_pylist() for k in ("raw", "asked", "id", "tie")), strict=True):
            for ask in asked:
                at = ask["a"]
                left = min(at, reach)
                body = raw[at - left : at + threshold]
                out[0].append(ask["digit"])
                out[1].append(i)
                out[2].append(tie)
                out[3].append(at)
                out[4].append(bytes([left]) + bytes(reach - left) + body)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.binary())],
            ["digit", "id", "tie", "at", "bytes"],
        )


def _window_hashes(body: list[bytes], digits: np.ndarray, threshold: int, digit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each offset the contexts that have a whole window there, and those windows' hashes."""
    reach = threshold - digit
    wide = threshold + reach
    up, down = _powers(wide + 1)
    size = np.fromiter(map(len, body), np.int64, len(body)) - 1
    grid = np.frombuffer(b"".join(x.ljust(wide + 1, b"\0") for x in body), np.uint8).reshape(len(body), wide + 1)
    pad = reach - grid[:, 0].astype(np.int64)
    sums = np.zeros((len(body), wide + 1), np.uint64)
    np.cumsum(_BYTE[grid[:, 1:]] * up[:wide], axis=1, out=sums[:, 1:])
    salt = digits.view(np.uint64) * np.uint64(_ODD)
    for o in range(reach + 1):
        fits = np.flatnonzero((o >= pad) & (o + threshold <= size))
        yield o, fits, _mixed((sums[fits, o + threshold] - sums[fits, o]) * down[o] + salt[fits])


def _windows(batches: Iterator[pa.RecordBatch], threshold: int, digit: int) -> Iterator[pa.RecordBatch]:
    """The last pass: of equal digits, equal windows at each offset; all but the first repeat."""
    reach = threshold - digit
    for run in complete_runs(batches, "digit", 8192):
        ids, at, ties, d = (run.column(k).to_numpy() for k in ("id", "at", "tie", "digit"))
        body = [x.as_py() for x in run.column("bytes")]
        low, high = np.full(len(body), threshold + reach), np.full(len(body), -1)
        for o, fits, h in _window_hashes(body, d, threshold, digit):
            if len(fits) < 2:
                continue
            order = np.argsort(h, kind="stable")
            new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
            first = fits[order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]]
            mine = fits[order]
            rep = mine[(ids[mine] != ids[first]) | (at[mine] != at[first])]
            low[rep] = np.minimum(low[rep], o)
            high[rep] = o
        hit = high >= 0
        yield _found(ids[hit], ties[hit], (at - reach + low)[hit], (at - reach + high + threshold)[hit], d[hit])


def _single_windows(batches: Iterator[pa.RecordBatch], threshold: int, digit: int) -> Iterator[pa.RecordBatch]:
    """Every window of the contexts as a row of its own, for digits that too many contexts share."""
    for batch in batches:
        for part in (batch.slice(k, 2048) for k in range(0, batch.num_rows, 2048)):
            ids, at, ties, d = (part.column(k).to_numpy() for k in ("id", "at", "tie", "digit"))
            for o, fits, h in _window_hashes([x.as_py() for x in part.column("bytes")], d, threshold, digit):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d[fits]), pa.array(np.full(len(fits), o, np.int32)), pa.array(h.view(np.int64)), *(pa.array(x[fits]) for x in (ids, ties, at))],
                    ["digit", "o", "h", "id", "tie", "at"],
                )


def whole_characters(parts: list[bytes]) -> str:
    """The text of what stays between cuts: a character of which a part was removed goes whole, and parts of two never make a third."""
    return "".join([p.decode("utf-8", "ignore") for p in parts])


def _remaining(batches: Iterator[pa.RecordBatch], decode: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, spans, texts = [], [], []
        for raw, found in zip(batch.column("_q_raw").to_pylist(), batch.column("_q_found").to_pylist(), strict=True):
            if not found:
                kept.append(raw)
                spans.append([])
                texts.append(None)
                continue
            packed = np.array(found, np.int64)
            _, a, b = _united(np.zeros(len(packed), np.int64), packed >> 32, packed & 0xFFFFFFFF)
            a, b = a.tolist(), b.tolist()
            parts = [raw[x:y] for x, y in zip([0, *b], [*a, len(raw)], strict=True)]
            kept.append(b"".join(parts))
            texts.append(whole_characters(parts) if decode else None)
            spans.append([{"start": x, "end": y} for x, y in zip(a, b, strict=True)])
        names = [n for n in batch.schema.names if not n.startswith("_q_")]
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        made = {"kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, span)} | ({"kept_text": pa.array(texts, pa.string())} if decode else {})
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made.values()], [*names, *made])


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 100, digit: int = 32, keep: list[str] | None = None, crowd: int = 50_000, decode: bool = False
) -> DataFrame:
    """The columns ``keep`` (default: the id) of every document with ``kept`` (binary: the bytes that stay) and ``spans``.

    ``spans`` are the maximal removed byte ranges: every byte of a ``threshold``-byte string
    that also starts earlier, at a smaller id or earlier in the same document. Overlapping
    occurrences count; matches never cross documents and are judged on the input.
    A null text is empty and a null id the smallest. Rows that share an id count as one
    document: strings that start at the same position of both are neither earlier.
    With ``decode`` a column ``kept_text`` has what stays of a text in whole characters, and
    null where nothing was removed.
    ``threshold`` must be under 250, so that a context's length fits a byte.

    Contexts of one digit meet in a task, up to ``crowd`` of them. Where more different
    contexts share a digit, as at the ends of a passage that very many texts quote, their
    windows are rows of their own, whose first place is found by a grouped minimum.
    """
    keep = kept_columns(docs, [id_col] if keep is None else keep, ("kept", "spans", "kept_text") if decode else ("kept", "spans"))
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    twice = docs.groupBy(ident.alias("i")).count().where("count > 1").limit(1).count()
    tie = F.xxhash64(F.col(text_col)) if twice else F.lit(0).cast("long")
    texts = docs.select(ident.alias("id"), tie.alias("tie"), text_bytes(text_col).alias("raw"))
    suffixes = texts.mapInArrow(lambda b: _suffixes(b, threshold, digit), _SUFFIX)
    suffixes = suffixes.repartition("digit").sortWithinPartitions("digit", "context", "id", "at")
    second = materialised(suffixes.mapInArrow(lambda b: _contexts(b, digit), _FOUND))

    asked = second.where("b = -1")
    crowded = asked.groupBy("digit").count().where(F.col("count") > crowd).select("digit")

    def contexts(of: DataFrame) -> DataFrame:
        places = of.groupBy("id", "tie").agg(F.collect_set(F.struct("a", "digit")).alias("asked"))
        whole = texts.dropDuplicates(["id", "tie"]) if twice else texts
        cut = whole.join(places.hint("shuffle_hash"), ["id", "tie"])
        return cut.mapInArrow(lambda b: _cut_contexts(b, threshold, digit), "digit long, id long, tie long, at int, bytes binary")

    if crowded.limit(1).count():
        windows = contexts(asked.join(crowded, "digit", "left_semi"))
        windows = windows.mapInArrow(lambda b: _single_windows(b, threshold, digit), "digit long, o int, h long, id long, tie long, at int")
        first = windows.groupBy("digit", "o", "h").agg(F.min(F.struct("id", "at")).alias("first"))
        later = windows.join(first, ["digit", "o", "h"]).where((F.col("first.id") != F.col("id")) | (F.col("first.at") != F.col("at")))
        start = F.col("at") - (threshold - digit) + F.col("o")
        alone = later.groupBy("id", "tie", "at", "digit").agg(F.min(start).alias("a"), (F.max(start) + threshold).alias("b"))
        second = second.unionByName(alone.select("id", "tie", "a", "b", "digit"))
        asked = asked.join(crowded, "digit", "left_anti")
    windows = contexts(asked).repartition("digit").sortWithinPartitions("digit", "id", "at")
    third = windows.mapInArrow(lambda b: _windows(b, threshold, digit), _FOUND)

    ranges = second.where("b >= 0").unionByName(third).select("id", "tie", (F.col("a").cast("long") * (1 << 32) + F.col("b")).alias("r"))
    found = ranges.groupBy("id", "tie").agg(F.collect_list("r").alias("_q_found"))
    found = found.withColumnsRenamed({"id": "_q_id", "tie": "_q_tie"})
    whole = docs.select(*quoted(keep), ident.alias("_q_i"), tie.alias("_q_t"), text_bytes(text_col).alias("_q_raw"))
    whole = whole.join(found.hint("shuffle_hash"), (F.col("_q_i") == F.col("_q_id")) & (F.col("_q_t") == F.col("_q_tie")), "left")
    whole = whole.select(*quoted(keep), "_q_raw", "_q_found")
    schema = ", ".join(f"`{n}` {t}" for n, t in whole.dtypes if not n.startswith("_q_"))
    return whole.mapInArrow(lambda b: _remaining(b, decode), f"{schema}, kept binary, spans array<struct<start:long,end:long>>{', kept_text string' if decode else ''}")
