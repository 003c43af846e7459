"""Byte-pair pieces of a sentencepiece model: encoding by a table of last tokens, and decoding."""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.common import kept_columns, quoted

SPACE = "▁"
codecs.register_error("a_mark_each_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class PieceTable:
    """Encodes as a merge-type sentencepiece model with byte fallback does.

    A prefix of a text has one last token in its encoding. The table stores it for each
    prefix: an automaton gives the pieces that end there, and the right one is compatible
    with the last token of the prefix before it, that is, merging the two strings' joint
    characters gives just these two tokens. Ids are then read backwards.

    No piece spans a space that follows another character, so the table is filled for a
    space-led chunk at a time; at most ``most`` words are remembered before memory is freed.
    """

    def __init__(self, model_file: str, most: int = 200_000):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        if not self.byte:
            raise ValueError("the model has no byte fallback")
        normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {self.pieces[i]: -model.get_score(i) for i in normal}
        self.id = {self.pieces[i]: i for i in normal}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.id):
            raise ValueError("a piece spans words")
        self.ends = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.ends.add_word(p, (i, len(p)))
        self.ends.make_automaton()
        self.shown: list[str | None] = [p.replace(SPACE, " ") for p in self.pieces]
        for i, b in self.byte_of.items():
            self.shown[i] = chr(b) if b < 128 else None
        self.most = most
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.chunks = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def merged(self, text: str) -> list[str]:
        """The merge procedure itself, for the few characters of a pair: best score first, then leftmost."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s < best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether piece ``right`` can follow ``left``; 0, the unknown piece, stands for what never merges."""
        first, second = self.pieces[left] if left else "", self.pieces[right]
        return self.merged(first + second) == ([first, second] if left else [second])

    def tokens(self, chunk: str) -> list[int]:
        """The ids of the last tokens from the end to the start, 0 for a character outside the model, reversed."""
        last = [0] * (len(chunk) + 1)
        size = [1] * (len(chunk) + 1)
        fits = self.fits
        for end, (i, n) in self.ends.iter(chunk):
            end += 1
            if last[end]:
                continue
            key = last[end - n] << 20 | i
            ok = fits.get(key)
            if ok is None:
                if len(fits) >= self.most:
                    fits.clear()
                ok = fits[key] = self.compatible(last[end - n], i)
            if ok:
                last[end], size[end] = i, n
        out, at = [], len(chunk)
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def encode(self, chunk: str) -> bytes:
        """The ids of a chunk as little-endian int32."""
        ids = self.tokens(chunk)
        if 0 in ids:
            whole, at = [], 0
            for i in ids:
                whole += [i] if i else [self.byte[b] for b in chunk[at].encode()]
                at += len(self.pieces[i]) if i else 1
            ids = whole
        return array("i", ids).tobytes()

    def word(self, word: str) -> bytes:
        """The ids of a word that a space leads."""
        ids = self.encode(SPACE + word)
        if len(word) <= 64:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode_text(self, text: str) -> bytes:
        if not text:
            return b""
        words = text.split(" ")
        if "" in words or SPACE in text:
            return b"".join([self.encode(c) for c in self.chunks.findall(SPACE + text.replace(" ", SPACE))])
        known, word = self.known.get, self.word
        return b"".join([known(w) or word(w) for w in words])

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes that are no valid UTF-8 become replacement characters, the added space goes."""
        try:
            text = "".join([self.shown[i] for i in ids])
            return text[1:] if text.startswith(" ") else text
        except TypeError:
            pass  # a byte of a longer character: bytes are gathered below
        out: list[str] = []
        run = bytearray()

        def flush() -> None:
            if run:
                out.append(run.decode("utf-8", "a_mark_each_byte"))
                run.clear()

        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
            else:
                flush()
                out.append(self.pieces[i])
        flush()
        text = "".join(out)
        return (text[1:] if text.startswith(SPACE) else text).replace(SPACE, " ")


@cache
def piece_table(model_file: str) -> PieceTable:
    """One table a worker process; the file must be at the same path on every node, like the library itself."""
    return PieceTable(model_file)


def _coded(batches: Iterator[pa.RecordBatch], model_file: str) -> Iterator[pa.RecordBatch]:
    table = piece_table(model_file)
    for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
        coded = [table.encode_text(x.as_py() or "") for x in batch.column("_q_text")]
        decoded = [table.decode(array("i", x).tolist()) for x in coded]
        offsets = np.cumsum([0, *(len(x) // 4 for x in coded)], dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), np.int32)))
        names = [n for n in batch.schema.names if n != "_q_text"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), ids, pa.array(decoded, pa.string())], [*names, "ids", "decoded"]
        )


def encode_pieces(docs: DataFrame, model_file: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all but the text) with ``ids`` (array<int>) and their ``decoded`` text.

    Encodes without begin or end ids. A null or empty text has no ids and decodes to an
    empty text; repeated rows, clashing names of other columns and texts of any length are
    fine. The work is per row, so nothing is shuffled and no key can be hot.
    """
    keep = kept_columns(docs, keep, ("ids", "decoded", text_col) if keep is None else ("ids", "decoded"))
    rows = docs.select(*quoted(keep), F.col(text_col).alias("_q_text"))
    schema = "".join(f"`{n}` {t}, " for n, t in rows.dtypes if n != "_q_text")
    return rows.mapInArrow(lambda b: _coded(b, model_file), f"{schema}ids array<int>, decoded string")
