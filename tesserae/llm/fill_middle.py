"""Fill-in-the-middle transformation.

Texts are cut into chunks where a rolling hash of their bytes says so, so that passages which documents share fall into
the same chunks. A chunk's summary (tokens, code points, whether letters stand at its ends) is remembered under its
bytes, which are compared whole. Summaries of chunks in a row combine into the text's count; the counts before each chunk
tell which one holds a cut, and only that one is looked into.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import strings

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80


class Summary(NamedTuple):
    """``tokens``: those that begin in the chunk, if no letter stands before it. ``points``: code points that begin in it."""

    tokens: int
    points: int
    begins: bool
    ends: bool


def starts(data: np.ndarray) -> np.ndarray:
    """Where tokens ``[A-Za-z]+|[^A-Za-z]`` of UTF-8 bytes begin, if no letter stands before them."""
    letter, out = _LETTER[data], _LEAD[data]
    out[1:] &= ~(letter[1:] & letter[:-1])
    return out


@dataclass(frozen=True)
class Chunks:
    """Cuts after bytes whose hash of the last 32 bytes has ``bits`` zeros on top: chunks of ``1 << bits`` bytes or so,
    ``least`` and ``most`` at the bounds. ``slice`` bytes are hashed at a time."""

    bits: int = 9
    least: int = 64
    most: int = 8192
    seed: int = 7
    slice: int = 1 << 22

    def cuts(self, data: np.ndarray) -> list[int]:
        """Ends of the chunks of ``data``."""
        gear = np.random.default_rng(self.seed).integers(0, 1 << 32, 256, np.uint32)
        marks: list[int] = []
        for begin in range(0, len(data), self.slice):  # 31 bytes before a slice belong to its first hashes
            context = min(begin, 31)
            value, width = gear[data[begin - context : begin + self.slice]], 1
            while width < 32:  # the hash of 2w bytes from two of w
                value[width:] += value[:-width] << np.uint32(width)
                width *= 2
            marks += (np.flatnonzero(value[context:] >> np.uint32(32 - self.bits) == 0) + (begin + 1)).tolist()
        out, at, size = [], 0, len(data)
        for mark in marks:
            while mark - at > self.most:
                at += self.most
                out.append(at)
            if mark - at >= self.least:
                out.append(mark)
                at = mark
        while size - at > self.most:
            at += self.most
            out.append(at)
        return out if at == size else [*out, size]


class ChunkCounts:
    """Summaries of chunks by their bytes, ``limit`` bytes of chunks at most; the older half goes first."""

    def __init__(self, chunks: Chunks, limit: int = 1 << 25):
        self.chunks, self.limit, self.size = chunks, limit // 2, 0
        self.known: dict[bytes, Summary] = {}
        self.older: dict[bytes, Summary] = {}
        self.counted = 0

    def summary(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)
        if found is not None:
            return found
        found = self.older.get(chunk)
        if found is None:
            data = np.frombuffer(chunk, np.uint8)
            found = Summary(int(starts(data).sum()), int(_LEAD[data].sum()), bool(_LETTER[data[0]]), bool(_LETTER[data[-1]]))
            self.counted += 1
        if self.size > self.limit:
            self.older, self.known, self.size = self.known, {}, 0
        self.known[chunk] = found
        self.size += len(chunk) + 200
        return found

    def index(self, data: bytes) -> TokenIndex:
        ends = self.chunks.cuts(np.frombuffer(data, np.uint8))
        parts = [self.summary(data[a:b]) for a, b in pairwise([0, *ends])]
        tokens, points, letter = [0], [0], False
        for x in parts:  # a run of letters over a border is one token
            tokens.append(tokens[-1] + x.tokens - (letter and x.begins))
            points.append(points[-1] + x.points)
            letter = x.ends
        return TokenIndex(data, [0, *ends], np.array(tokens), points)


@dataclass(frozen=True)
class TokenIndex:
    """Counts of tokens and code points before each chunk of ``data``."""

    data: bytes
    ends: list[int]
    tokens: np.ndarray
    points: list[int]

    @property
    def n(self) -> int:
        return int(self.tokens[-1])

    def place(self, token: int) -> tuple[int, int]:
        """Byte and code point at which token ``token`` begins; the text's ends for its count."""
        if token >= self.n:
            return len(self.data), self.points[-1]
        k = int(np.searchsorted(self.tokens, token, "right")) - 1
        begin = self.ends[k]
        # one byte before the chunk tells whether a run of letters goes on
        data = np.frombuffer(self.data[max(begin - 1, 0) : self.ends[k + 1]], np.uint8)
        at = np.flatnonzero(starts(data)[min(begin, 1) :])[token - int(self.tokens[k])]
        return begin + int(at), self.points[k] + int(_LEAD[data[min(begin, 1) :][:at]].sum())


@dataclass(frozen=True)
class FillInMiddle:
    """``rate`` of 100 texts are transformed, ``spm`` of 100 of these with the suffix first. ``marks``: before prefix,
    suffix and middle. Draws are a function of ``seed`` and the doc_id."""

    rate: int = 90
    spm: int = 20
    seed: int = 1
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    chunks: Chunks = Chunks()

    def draws(self, doc_id: int | None) -> tuple[int, int, int, int]:
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))

    def form(self, data: bytes, h3: int, h4: int) -> str:
        if not data or h3 % 100 >= self.rate or any(x.encode() in data for x in self.marks):
            return "plain"
        return "spm" if h4 % 100 < self.spm else "psm"

    def apply(self, docs: DataFrame) -> DataFrame:
        """``doc_id, n, form, prefix_chars, middle_chars, output`` of each row of ``docs`` (``doc_id, text``).

        ``n``: tokens ``[A-Za-z]+|[^A-Za-z]``, at two of which the text is cut. A null text counts as empty, and an empty
        text or one that holds a mark stays plain, with null lengths. A null id draws as the empty one; rows with equal ids
        have equal draws, repeated rows come out repeated. Texts of any length are read whole; other columns are ignored;
        an empty table gives no rows.
        """
        prefix, suffix, middle = (x.encode() for x in self.marks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = ChunkCounts(self.chunks)
            for batch in batches:
                rows: list[tuple] = []
                size, begin = 0, 0
                ids, texts = batch.column(0).to_pylist(), strings(batch.column(1))
                for i, (doc_id, data) in enumerate(zip(ids, texts, strict=True)):
                    data, texts[i] = data or b"", None
                    h1, h2, h3, h4 = self.draws(doc_id)
                    index = counts.index(data)
                    form = self.form(data, h3, h4)
                    if form == "plain":
                        rows.append((index.n, form, None, None, data))
                    else:
                        first, second = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
                        (a, x), (b, y) = index.place(first), index.place(second)
                        head, body, tail = data[:a], data[a:b], data[b:]
                        order = (prefix, head, suffix, tail) if form == "psm" else (suffix, tail, prefix, head)
                        rows.append((index.n, form, x, y - x, b"".join((*order, middle, body))))
                    size += len(data)
                    if size > 1 << 22 or i + 1 == len(ids):
                        yield self._batch(batch.column(0).slice(begin, len(rows)), rows)
                        rows, size, begin = [], 0, i + 1

        schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)

    @staticmethod
    def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        n, form, head, body, out = zip(*rows, strict=True)
        longs = [pa.array(x, pa.int64()) for x in (n, head, body)]
        texts = pa.array(out, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([ids, longs[0], pa.array(form, pa.string()), *longs[1:], texts], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def restored(self, form: str = "form", output: str = "output") -> Column:
        """The text that an output of :meth:`apply` was made from."""
        part = F.split(output, "|".join(f"\\Q{x}\\E" for x in self.marks), -1)
        psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
        return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
