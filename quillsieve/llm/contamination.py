"""Benchmark passages in documents, within an edit distance: CGK embeddings, bit-sampling LSH, exact verification."""

from __future__ import annotations

import random
import warnings
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import kept_columns, quoted

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Array cells that one step works on at most.
CELLS = 4_000_000


def normalised(text: str | None) -> str:
    """Lower case, white space as single spaces, one before and one after; empty for a text without words."""
    words = text.lower().split() if text else []
    return f" {' '.join(words)} " if words else ""


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def least_edits(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the first best match of the whole pattern in a part of the text, if within ``most`` edits."""
    m = len(pattern)
    mask: dict[str, int] = {}
    for k, c in enumerate(pattern):
        mask[c] = mask.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, (m, 0)
    for end, c in enumerate(text, 1):
        eq = mask.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(xh | plus) & full)
        down = plus & xh
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (~(xv | up) & full), up & xv
        if score < best[0]:
            best = (score, end)
    return best if best[0] <= most else None



def gram_size(length: int, budget: int, most: int = 8) -> int:
    """The longest run of characters, up to ``most``, of which ``budget`` edits leave one whole at least."""
    return max(1, min(most, length // (budget + 1)))


def grams(points: np.ndarray, size: int) -> np.ndarray:
    """A digest of every run of ``size`` characters."""
    n = len(points) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x100000001B3) + points[k : k + n]
    return _mixed(h)


class Walks:
    """CGK embeddings of windows, and the LSH keys of their samples.

    At each of twice the length's steps a walk shows a character and goes on to the next one
    or stays, by a random bit for the step and the character. After an edit the walks over
    two texts come together again by chance, so they show the same characters over long
    stretches. A table samples ``sampled`` of ``span`` successive steps of one walk, at a place that
    is the same share of the length for all windows.
    """

    def __init__(self, walks: int, tables: int = 24, sampled: int = 6, span: int = 12, seed: int = 11):
        self.walks, self.tables, self.sampled, self.span, self.seed = walks, tables, sampled, span, seed
        rng = np.random.default_rng(seed)
        self.at = rng.random((walks, tables))
        self.within = np.sort(np.argsort(rng.random((walks, tables, span)), axis=2)[:, :, :sampled], axis=2)
        self.salt = rng.integers(1, 2**63, (walks, tables), dtype=np.uint64)

    def keys(self, windows: list[str], lengths: np.ndarray) -> np.ndarray:
        """(windows, walks x tables): a key for each table; a window is cut or padded to its length."""
        n, wide = len(windows), int(lengths.max())
        grid = np.zeros((n, wide + 1), np.uint32)
        for row, (w, length) in enumerate(zip(windows, lengths.tolist(), strict=True)):
            p = points_of(w[:length])
            grid[row, : len(p)] = p
        code = ((grid * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.uint64)
        rows = np.arange(n)[None, :] * (wide + 1)
        grid, code = grid.ravel(), code.ravel()
        seen = np.zeros((2 * wide, self.walks, n), np.uint32)
        at = np.zeros((self.walks, n), np.int64)
        step = np.arange(2 * wide, dtype=np.uint64)[:, None] << np.uint64(16)
        bits = _mixed(np.arange(self.walks, dtype=np.uint64)[None, :] + (step + np.uint64(self.seed)) * _MIX)  # a bit for each of 64 classes of characters
        one = np.uint64(1)
        for j in range(2 * wide):
            here = rows + at
            seen[j] = grid[here]
            at += ((bits[j, :, None] >> code[here]) & one).astype(np.int64)
            np.minimum(at, lengths, out=at)
        first = (self.at[:, :, None] * np.maximum(2 * lengths - self.span, 1)).astype(np.int64)
        walk, row = np.arange(self.walks)[:, None, None], np.arange(n)[None, None, :]
        key = lengths.astype(np.uint64) * _MIX + self.salt[:, :, None]
        for k in range(self.sampled):
            place = np.minimum(first + self.within[:, :, k, None], 2 * lengths - 1)
            key = _mixed(key + seen[place, walk, row].astype(np.uint64) * _MIX)
        return key.reshape(self.walks * self.tables, n).T

    def keys_of(self, windows: list[tuple[str, int]]) -> np.ndarray:
        """Keys of windows with their lengths, so many at once as ``CELLS`` allow."""
        out = np.zeros((len(windows), self.walks * self.tables), np.uint64)
        lengths = np.array([n for _, n in windows], np.int64)
        order = np.argsort(lengths, kind="stable")[::-1]
        first = 0
        while first < len(order):
            some = order[first : first + max(1, CELLS // (2 * int(lengths[order[first]]) * self.walks))]
            out[some] = self.keys([windows[k][0] for k in some.tolist()], lengths[some])
            first += len(some)
        return out


def edited(text: str, edits: int, kind: str, rng: random.Random) -> str:
    """The text after so many edits: ``even`` substitutions, ``random`` ones of any sort, or a ``block`` of substitutions."""
    chars = list(text)
    other = lambda c: rng.choice([x for x in "abcdefghijklmnopqrstuvwxyz" if x != c])
    if kind == "random":
        for _ in range(edits):
            place, sort = rng.randrange(len(chars)), rng.randrange(3)
            if sort == 0:
                chars[place] = other(chars[place])
            elif sort == 1:
                chars.insert(place, other(""))
            elif len(chars) > 1:
                del chars[place]
        return "".join(chars)
    first = rng.randrange(max(1, len(chars) - edits))
    places = [k * len(chars) // max(edits, 1) for k in range(edits)] if kind == "even" else range(first, first + edits)
    for place in places:
        chars[place] = other(chars[place])
    return "".join(chars)


def walks_for(texts: list[str], share: float, target: float, stride: float, copies: int = 120) -> int:
    """The least number of walks (a power of two up to 32) whose tables bring that share of edited copies together.

    Copies have all the edits that ``share`` allows, even and random ones by turns, and a
    window starts half a stride away from them, which is the worst that the search does. Warns
    with the share reached where 32 walks fall short of it.
    """
    texts = [t for t in texts if int(share * len(t)) > 0]
    if not texts:
        return 2
    rng = random.Random(5)
    pairs = []
    for k in range(copies):
        t = texts[k % len(texts)]
        budget = int(share * len(t))
        off = max(1, int(stride * budget)) // 2
        pairs.append((t, ("".join(rng.choice("etaoin") for _ in range(off)) + edited(t, budget, ("even", "random")[k % 2], rng))[: len(t)]))
    walks = 2
    while True:
        own = Walks(walks)
        a, b = (own.keys_of([(p[i], len(p[0])) for p in pairs]) for i in (0, 1))
        reached = (a == b).any(axis=1).mean()
        if reached >= target:
            return walks
        if walks == 32:
            warnings.warn(f"32 walks bring {reached:.3f} of the edited copies together, less than the target of {target}", stacklevel=2)
            return walks
        walks *= 2


class ItemIndex:
    """A block of benchmark items with their runs of characters and LSH tables.

    A text is cut into windows of the size of an item wherever the item can be at all: an
    item of n characters within k edits leaves at least n - q + 1 - k q of its runs of q
    characters whole, within k diagonals (the q-gram lemma), so elsewhere no window is
    embedded and none is lost. Windows start at every ``stride`` of the budget there; those
    that share a key with an item are compared with it exactly.
    """

    def __init__(self, ids: list, texts: list[str], share: float = 0.1, walks: int = 8, stride: float = 0.2, common: int = 32):
        self.ids, self.texts, self.share, self.stride = ids, texts, share, stride
        self.size = np.array([len(t) for t in texts], np.int64)
        self.budget = (self.size * share).astype(np.int64)
        self.longest = int(self.size.max(initial=1))
        self.walks = Walks(walks)
        self.least = np.zeros(len(texts), np.int64)
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list[int]] = {}
        for k, (n, b) in enumerate(zip(self.size.tolist(), self.budget.tolist(), strict=True)):
            q = gram_size(n, b)
            by_size.setdefault(q, []).append(k)
            self.least[k] = max(1, n - q + 1 - b * q)
        for q, own in by_size.items():
            each = [grams(points_of(texts[k]), q) for k in own]
            h, item = np.concatenate(each), np.repeat(own, [len(x) for x in each])
            offset = np.concatenate([np.arange(len(x)) for x in each])
            order = np.argsort(h, kind="stable")
            h, item, offset = h[order], item[order], offset[order]
            # runs of many items are left out, as many as an item can spare: its least number falls by each
            new = np.concatenate(([True], h[1:] != h[:-1]))
            often = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
            spare = self.least - np.maximum(3, self.least // 2)
            by_item = np.lexsort((-often, item))
            place = np.empty(len(h), np.int64)
            place[by_item] = np.arange(len(h)) - np.searchsorted(item[by_item], item[by_item], "left")
            gone = (often > common) & (place < spare[item])
            self.least = self.least - np.bincount(item[gone], minlength=len(texts))
            h, item, offset = h[~gone], item[~gone], offset[~gone]
            sieve = np.zeros(1 << 22, bool)
            sieve[(h >> np.uint64(42)).astype(np.int64)] = True
            self.runs[q] = (h, item, offset, sieve)
        keys = self.walks.keys_of(list(zip(texts, self.size.tolist(), strict=True)))
        flat = keys.ravel()
        order = np.argsort(flat, kind="stable")
        self.keys, self.of_key = flat[order], order // max(keys.shape[1], 1)

    def regions(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text, item, first start, last start) of all places at which an item can begin."""
        parts = [points_of(t) for t in texts]
        size = np.array([len(p) for p in parts], np.int64)
        start = np.cumsum(size) - size
        every = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        found: list[tuple[int, int, int, int]] = []
        for q, (digests, item_of, offset_of, sieve) in self.runs.items():
            h = grams(every, q)
            at = np.flatnonzero(sieve[(h >> np.uint64(42)).astype(np.int64)])
            lo = np.searchsorted(digests, h[at], "left")
            n = np.searchsorted(digests, h[at], "right") - lo
            doc = np.searchsorted(start, at, side="right") - 1
            good = (n > 0) & (at + q <= start[doc] + size[doc])
            at, lo, n, doc = at[good], lo[good], n[good], doc[good]
            if not len(at):
                continue
            wide = int(size.max()) + 2 * self.longest + 2
            key, hits = self._diagonals(at - start[doc], doc, lo, n, item_of, offset_of, wide)
            item = (key // wide) % len(self.texts)
            upto = np.concatenate(([0], np.cumsum(hits)))
            enough = upto[np.searchsorted(key, key + self.budget[item], "right")] - upto[:-1] >= self.least[item]
            key, item = key[enough], item[enough]
            if not len(key):
                continue
            group, first = key // wide, key % wide - self.longest
            budget = self.budget[item]
            new = np.concatenate(([True], (group[1:] != group[:-1]) | (first[1:] - budget[1:] > first[:-1] + budget[:-1])))
            last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(key) - 1]))
            a, b = (first - budget)[new], (first + budget)[last]
            found += zip((group[new] // len(self.texts)).tolist(), item[new].tolist(), a.tolist(), b.tolist(), strict=True)
        return found

    def _diagonals(
        self, at: np.ndarray, doc: np.ndarray, lo: np.ndarray, n: np.ndarray, item_of: np.ndarray, offset_of: np.ndarray, wide: int, most: int = 1 << 19
    ) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, item, diagonal) as sorted numbers, and the hits of each.

        ``n`` gives how many grams of items, from ``lo`` on, each place of a text meets. Hits are
        made ``most`` at a time and counted at once, so a repetitive text and item, which have a
        hit for every pair of their places, hold a number for each diagonal only.
        """
        ends = np.cumsum(n)
        cuts = np.unique(np.concatenate(([0], np.searchsorted(ends, np.arange(most, int(ends[-1]), most), "right"), [len(n)])))
        keys, counts, held, distinct = [], [], 0, 0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            m = n[a:b]
            of = np.repeat(lo[a:b] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            key = (np.repeat(doc[a:b], m) * len(self.texts) + item_of[of]) * wide + np.repeat(at[a:b], m) - offset_of[of] + self.longest  # from 0 on
            for to, got in zip((keys, counts), np.unique(key, return_counts=True), strict=True):
                to.append(got)
            held += len(keys[-1])
            if held > 2 * distinct + 4 * most or b == len(n):
                key, of_key = np.unique(np.concatenate(keys), return_inverse=True)
                summed = np.bincount(of_key, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)
                keys, counts, held, distinct = [key], [summed], len(key), len(key)
        return keys[0], counts[0]

    def _pieces(self, texts: list[str], most: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
        """Texts in blocks of at most ``most`` characters; a longer one in parts that overlap by more than an item."""
        over = 2 * self.longest + 2
        docs: list[int] = []
        shift: list[int] = []
        parts: list[str] = []
        held = 0
        for d, t in enumerate(texts):
            for first in range(0, max(len(t) - over, 1), most):
                part = t[first : first + most + over]
                if parts and held + len(part) > most:
                    yield docs, shift, parts
                    docs, shift, parts, held = [], [], [], 0
                docs.append(d)
                shift.append(first)
                parts.append(part)
                held += len(part)
        if parts:
            yield docs, shift, parts

    def leaks(self, texts: list[str], block_chars: int = 400_000) -> list[list[dict]]:
        """For each normalised text, its items with the place and distance of the best match."""
        best: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        if self.texts:
            for docs, shift, parts in self._pieces(texts, max(block_chars, 4 * self.longest)):
                for p, k, distance, start in self._matches(parts):
                    own = best[docs[p]]
                    if k not in own or (distance, shift[p] + start) < own[k]:
                        own[k] = (distance, shift[p] + start)
        out = []
        for own in best:
            by_id: dict[int, tuple[int, int]] = {}
            for k, got in own.items():
                by_id[self.ids[k]] = min(got, by_id.get(self.ids[k], got))
            out.append([{"item_id": i, "start": max(0, s - 1), "distance": e} for i, (e, s) in sorted(by_id.items())])
        return out

    def _matches(self, parts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, distance, start) of verified matches."""
        windows: list[tuple[int, int, int]] = []
        for p, k, a, b in self.regions(parts):
            step = max(1, int(self.stride * self.budget[k]))
            starts = range(max(a, 0), max(min(b, len(parts[p]) - 1), max(a, 0)) + 1, step)
            windows += [(p, s, int(self.size[k])) for s in starts]
        windows = sorted(set(windows))
        near: dict[tuple[int, int], list[int]] = {}
        for first in range(0, len(windows), 4096):
            some = windows[first : first + 4096]
            keys = self.walks.keys_of([(parts[p][s : s + n], n) for p, s, n in some])
            lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            for w in np.flatnonzero((hi > lo).any(axis=1)).tolist():
                p, s, _ = some[w]
                met = {int(k) for x, y in zip(lo[w].tolist(), hi[w].tolist(), strict=True) if y > x for k in self.of_key[x:y]}
                for k in met:
                    near.setdefault((p, k), []).append(s)
        for (p, k), starts in sorted(near.items()):
            n, budget = int(self.size[k]), int(self.budget[k])
            runs = [[starts[0], starts[0]]]
            for s in starts[1:]:
                if s - runs[-1][1] <= n:
                    runs[-1][1] = s
                else:
                    runs.append([s, s])
            for a, b in runs:
                low = max(0, a - budget - 1)
                part = parts[p][low : b + n + budget + 1]
                at = part.find(self.texts[k])
                got = (0, at + n) if at >= 0 else least_edits(self.texts[k], part, budget) if budget else None
                if got is not None:
                    yield p, k, got[0], max(0, low + got[1] - n)


@lru_cache(maxsize=1)
def _index(key: str, items: tuple[tuple, ...], share: float, walks: int) -> ItemIndex:
    """One index a worker process, which serves one block of items."""
    return ItemIndex([i for i, _ in items], [t for _, t in items], share, walks)


def _marked(batches: Iterator[pa.RecordBatch], shared, key: str, share: float, walks: int) -> Iterator[pa.RecordBatch]:
    own = _index(key, shared.value, share, walks)
    for batch in batches:
        found = own.leaks([normalised(x) for x in batch.column("_q_text").to_pylist()])
        found = [merged(a, b) for a, b in zip(batch.column("leaks").to_pylist(), found, strict=True)]
        names = [n for n in batch.schema.names if n != "leaks"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, batch.schema.field("leaks").type)], [*names, "leaks"])


def merged(a: list[dict], b: list[dict]) -> list[dict]:
    """The leaks of two blocks; of an item in both, the nearer match."""
    best: dict[int, dict] = {}
    for x in (*a, *b):
        if x["item_id"] not in best or (x["distance"], x["start"]) < (best[x["item_id"]]["distance"], best[x["item_id"]]["start"]):
            best[x["item_id"]] = x
    return [best[i] for i in sorted(best)]


def cut_item(text: str, most: int) -> list[str]:
    """A normalised item in passages of at most ``most`` characters, cut between words where there are any; each is searched for on its own."""
    out = []
    while len(text) > most:
        at = text.rfind(" ", most // 2, most)
        at = at if at > 0 else most
        out.append(text[: at + 1])
        text = text[at:]
    return [*out, text]


def find_leaks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None,
    share: float = 0.1, target_recall: float = 0.99, stride: float = 0.2, block_chars: int = 2_000_000, most_item: int = 2000,
) -> DataFrame:
    """The columns ``keep`` (default: all) of every document with ``leaks``: items that it holds within ``share`` of their length in edits.

    Texts are compared in lower case with single spaces, with a space before and after, so
    that an item too short for any edit is found as whole words; ``start`` counts in that form.
    The number of walks follows from ``target_recall``. Items of more than ``most_item``
    characters are searched for in passages of that size, of which one is enough. Null
    and empty texts have no leaks; null or empty items and ids match nothing; repeated rows
    keep a row each; of repeated items the nearest match counts. The texts of items are
    broadcast in blocks of about ``block_chars`` characters, whose number is checked first: a
    larger benchmark takes more passes over the rows, none of which shuffles. Tasks embed
    items and windows in parts of bounded size; a repetitive item takes memory for each of its
    diagonals in a part of a text, not for each pair of equal runs.
    """
    keep = kept_columns(docs, keep, ("leaks",))
    sc = docs.sparkSession.sparkContext
    known = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull()).select(F.col(item_id).alias("id"), F.col(item_text).alias("text"))
    leaks = f"array<struct<item_id:{known.schema['id'].dataType.simpleString()},start:int,distance:int>>"
    found = docs.select(*quoted(keep), F.col(text_col).alias("_q_text"), F.array().cast(leaks).alias("leaks"))
    total = known.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = 1 + total // block_chars
    schema = ", ".join(f"`{n}` {t}" for n, t in found.dtypes if n != "leaks")
    walks = None
    for k in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).orderBy("id", "text").collect()
        texts = tuple(sorted({(r.id, part) for r in rows for part in cut_item(normalised(r.text), most_item) if part}))
        if walks is None and texts:
            walks = walks_for([t for _, t in texts[:: max(1, len(texts) // 100)]], share, target_recall, stride)
        if texts:
            shared, key, n = sc.broadcast(texts), f"{sc.applicationId}-{k}-{hash(texts)}", walks
            found = found.mapInArrow(lambda b, shared=shared, key=key, n=n: _marked(b, shared, key, share, n), f"{schema}, leaks {leaks}")
    return found.drop("_q_text")
