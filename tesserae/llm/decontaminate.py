"""Benchmark decontamination by template windows.

Numbers, units after them and names (capitals inside a sentence) become typed placeholders, runs of one type a single
one, so that a question with other values, of any number of words, has the same template. Windows of plain words and of
template words are hashed and joined to those of the benchmark. The values behind the placeholders, the slots, must then
correspond: one value of the benchmark to one of the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr ms hz khz mhz ghz w kw v a k c f pa bar j kj cal kcal mol"
    " percent cent cents dollar dollars euro euros pound pounds second seconds minute minutes hour hours day days week weeks"
    " month months year years meter meters metre metres inch inches foot feet mile miles gram grams liter liters litre litres"
    " degree degrees usd eur gbp".split()
)
LITERAL, NUMBER, UNIT, NAME, NOTHING = range(5)
_CORE = re.compile(r"^[\W_]+|[\W_]+$")
_NUMBER = re.compile(r"(\d[\d.,:/]*)(\D*)")
_PLACES = {kind: np.uint64(xxhash.xxh64_intdigest(b"\x00%d" % kind, 7) & ~15) for kind in (NUMBER, UNIT, NAME)}
_PLACE_OF = np.array([_PLACES.get(kind, np.uint64(0)) for kind in range(5)], np.uint64)
_FACTOR = 0x9E3779B97F4A7C15


class _Words(dict):
    """By word between white space: 60 bits of hash, 3 of kind, 1 for the end of a sentence."""

    def __missing__(self, word: str) -> int:
        core = _CORE.sub("", word)
        last = word.rstrip("\"')]}»”")[-1:] in {".", "!", "?", ":"}
        if not core:
            kind = NOTHING
        elif (m := _NUMBER.fullmatch(core)) and (not m[2] or m[2].lower() in UNITS):
            kind = NUMBER
        elif core.lower() in UNITS:
            kind = UNIT
        else:
            kind = NAME if core[0].isupper() else LITERAL
        value = self[word] = xxhash.xxh64_intdigest(core.lower().encode("utf-8", "surrogatepass"), 7) & ~15 | kind << 1 | last
        return value


#: Scripts that put no spaces between words: each of their letters counts as a word.
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return (text if text.isascii() else _UNSPACED.sub(r" \1 ", text)).split()


def _rolled(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` values."""
    count = max(0, len(values) - size + 1)
    hashes, factor = np.full(count, size, np.uint64), 1
    for k in range(size):
        hashes += values[k : k + count] * np.uint64(factor)
        factor = factor * _FACTOR % (1 << 64)
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ hashes >> np.uint64(32)


class Template:
    """Words of a text with their hashes, and the template's places: runs of words behind one placeholder, and other words."""

    def __init__(self, text: str | None, known: _Words):
        words = words_of(text)
        packed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        kind = (packed >> np.uint64(1) & np.uint64(7)).astype(np.int8)
        some = np.flatnonzero(kind != NOTHING)
        if len(some) < len(words):
            words, packed, kind = [words[i] for i in some.tolist()], packed[some], kind[some]
        n = len(words)
        ends = packed & np.uint64(1) == 1
        start, after = np.ones(n, bool), np.zeros(n, bool)
        start[1:], after[1:] = ends[:-1], kind[:-1] == NUMBER
        kind = np.where((kind == NAME) & start | (kind == UNIT) & ~after, LITERAL, kind)
        self.words, self.plain = words, packed & ~np.uint64(15)
        first = np.ones(n, bool)
        first[1:] = (kind[1:] == LITERAL) | (kind[1:] != kind[:-1])
        self.first = np.flatnonzero(first)
        self.kind = kind[self.first]
        self.typed = np.where(self.kind == LITERAL, self.plain[self.first], _PLACE_OF[self.kind])

    def literals(self, size: int) -> np.ndarray:
        """How many words of each window of the template are no placeholders."""
        total = np.concatenate(([0], np.cumsum(self.kind == LITERAL)))
        return total[size:] - total[: max(0, len(total) - size)]

    def values(self, at: int, size: int) -> list[str]:
        """What stands behind the placeholders of a window."""
        ends = [*self.first[at + 1 : at + size + 1].tolist(), len(self.words)]
        spans = zip(self.first[at : at + size].tolist(), ends, self.kind[at : at + size].tolist(), strict=False)
        return [" ".join(_CORE.sub("", x).lower() for x in self.words[a:b]) for a, b, kind in spans if kind != LITERAL]


@dataclass(frozen=True)
class Decontamination:
    """Windows of ``size`` words; those of templates need ``literals`` words that are no placeholders.

    A text matches an item when ``share`` of the item's windows are found in it, or ``run`` of its words in a row. An item
    of fewer than ``size`` words is one window of its own length, without placeholders. ``bitmap_bits``: log2 of the bits
    of the filter that tasks look windows up in before the join, whose size this bounds.
    """

    size: int = 8
    literals: int = 4
    share: float = 0.5
    run: int = 20
    bitmap_bits: int = 24
    memo: int = 300_000

    def _windows(self, texts: DataFrame, only: np.ndarray | None, sizes: tuple[int, ...]) -> DataFrame:
        """``id, at, n, size, hash, typed, slots`` of the windows of ``id, text`` rows; n: of that size and type.

        ``only``: those in this bitmap, of any of ``sizes``; without it, all of ``sizes[0]`` or one of a shorter text.
        """
        literals, memo, full = self.literals, self.memo, self.size
        shared = None if only is None else texts.sparkSession.sparkContext.broadcast(only)
        schema = pa.schema([("id", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("size", pa.int32()), ("hash", pa.int64()), ("typed", pa.bool_()), ("slots", pa.list_(pa.string()))])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, bitmap, rows = _Words(), None if shared is None else shared.value, []
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    found = Template(text.as_py(), known)
                    own = sizes if bitmap is not None else (min(full, len(found.words)),) * bool(found.words)
                    for size, typed in [(size, False) for size in own] + [(full, True)] * (full in own):
                        hashes = _rolled(found.typed if typed else found.plain, size)
                        counts = found.literals(size) >= literals if typed else np.ones(len(hashes), bool)
                        n = int(counts.sum())
                        if bitmap is not None and n:
                            place = hashes & np.uint64(bitmap.size * 64 - 1)
                            counts &= bitmap[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) == 1
                        for at in np.flatnonzero(counts).tolist():
                            rows.append((key, at, n, size, int(hashes[at].astype(np.int64)), typed, found.values(at, size) if typed else []))
                    if len(rows) >= 20_000:
                        yield batch_of(rows)
                        rows = []
                if len(known) > memo:
                    known.clear()
            if rows:
                yield batch_of(rows)

        return texts.mapInArrow(run, "id long, at int, n int, size int, hash long, typed boolean, slots array<string>")

    def _bitmap(self, items: DataFrame) -> np.ndarray:
        place = F.col("hash").bitwiseAND(F.lit((1 << self.bitmap_bits) - 1))
        words = items.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word"))
        words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("bits")).toArrow()
        out = np.zeros(1 << (self.bitmap_bits - 6), np.int64)
        out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
        return out.view(np.uint64)

    def matches(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        """``doc_id, item_id, kind, share`` for each text that holds an item; ``kind``: copy or re-parameterised.

        ``docs``: ``doc_id, text``; ``benchmark``: ``item_id, text``; other columns are ignored. Null and empty texts
        match nothing, nor do rows with null ids. Repeated rows count once, and so does a passage that a text repeats;
        an empty table on either side gives no rows. Copies may differ in case and punctuation, and in up to
        1 - ``share`` of their windows anywhere, or hold ``run`` words of the item; with other values, each of the item's
        slots has one value, in the whole text or along one alignment with the item. Items may have any length.
        """
        items = benchmark.select(F.col("item_id").cast("long").alias("id"), "text").where("id is not null")
        items = keep(self._windows(items, None, (self.size,)).distinct(), "benchmark-windows")
        # numbers of words below ``size``, and ``size``
        sizes = tuple(sorted({self.size, *(x["size"] for x in items.select("size").distinct().collect())}))
        texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
        # shuffled or broadcast by size, as Spark finds it
        found = keep(self._windows(texts, self._bitmap(items), sizes), "document-windows").withColumnsRenamed({"id": "doc_id", "at": "place", "slots": "values"})
        found = found.drop("n").join(items.withColumnRenamed("id", "item_id"), ["hash", "typed", "size"])
        least = F.ceil(F.col("n") * self.share)
        one, line = ["doc_id", "item_id", "n"], (F.col("place") - F.col("at")).alias("line")
        plain, typed = found.where(~F.col("typed")), found.where("typed and size(slots) = size(values)")
        copies = plain.select(*one, "at").distinct().groupBy(*one).agg(F.count("*").alias("found")).where(F.col("found") >= least)
        # windows of a line that follow each other
        order = Window.partitionBy(*one, "line").orderBy("at")
        runs = plain.where(F.col("size") == self.size).select(*one, line, "at").distinct().withColumn("island", F.col("at") - F.row_number().over(order))
        runs = runs.groupBy(*one, "line", "island").agg(F.count("*").alias("found")).where(F.col("found") >= self.run - self.size + 1)
        changed = None
        for by in (one, [*one, "line"]):
            rows = typed.select(*one, line, "at", F.arrays_zip("slots", "values").alias("pairs"))
            there = rows.select(*by, "at").distinct().groupBy(*by).agg(F.count("*").alias("found")).where(F.col("found") >= least)
            values = rows.select(*by, F.explode("pairs").alias("p")).groupBy(*by, "p.slots").agg(F.min("p.values").alias("a"), F.max("p.values").alias("b"))
            broken = values.where("a <> b").select(*by).distinct()
            whole = there.join(broken, by, "left_anti").select(*one, "found")
            changed = whole if changed is None else changed.unionByName(whole)
        both = copies.unionByName(runs.select(*one, "found")).withColumn("kind", F.lit("copy")).unionByName(changed.withColumn("kind", F.lit("re-parameterised")))
        best = both.groupBy("doc_id", "item_id").agg(F.min("kind").alias("kind"), F.max(F.col("found") / F.col("n")).alias("share"))
        return best.select("doc_id", "item_id", "kind", "share")

    def clean(self, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
        """The rows of ``docs`` that hold no item, whatever their doc_ids; all columns stay."""
        every = keep(docs.select(F.struct(*docs.columns).alias("doc")).withColumn("node", F.monotonically_increasing_id()), "rows")
        found = self.matches(every.select(F.col("node").alias("doc_id"), "doc.text"), benchmark)
        drop = keep(found.select(F.col("doc_id").alias("node")).distinct(), "contaminated")
        return every.join(drop, "node", "left_anti").select("doc.*")
