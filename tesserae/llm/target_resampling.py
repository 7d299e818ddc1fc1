"""Importance resampling towards a target distribution.

Runs of one to three words are features. Each batch interns its features in an open-addressed table of NumPy arrays: their
xxhash64 is the key, bytes are compared before a slot counts as found, and a slot stores its feature's bucket and count.
Counts of buckets are summed over all texts; in the second pass the slots' gains are gathered by the slot of each
occurrence. Gumbel noise turns the sums into keys, the largest of which are a sample without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import running
from .common import keep, strings, text_slices

#: Bytes of words: digits, letters and all of UTF-8 beyond ASCII; others are 0. A-Z are lower-cased.
_WORD = np.zeros(256, np.uint8)
for _some in (range(48, 58), range(97, 123), range(128, 256)):
    _WORD[[*_some]] = [*_some]
_WORD[65:91] = _WORD[97:123]
_SPACE = 32
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


class Ranges:
    """Byte ranges of a buffer. ``eight``: the little-endian number that begins at each byte."""

    def __init__(self, data: np.ndarray):
        self.data = data
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        self.eight = np.zeros(len(data) + 1, np.uint64)
        for k in range(8):
            self.eight |= padded[k : k + len(data) + 1].astype(np.uint64) << np.uint64(8 * k)
        self.raw = memoryview(data.tobytes())

    def hashes(self, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """XXH64 of each range, seed 0."""
        h = size.astype(np.uint64) + _P5
        some = np.flatnonzero(size >= 8)
        for k in range(3):  # whole numbers of eight bytes, of ranges up to 31
            some = some[size[some] >= 8 * (k + 1)]
            lane = _turned(self.eight[begin[some] + 8 * k] * _P2, 31) * _P1
            h[some] = _turned(h[some] ^ lane, 27) * _P1 + _P4
        at, left = begin + (size & ~7), size & 7
        some = np.flatnonzero(left >= 4)
        h[some] = _turned(h[some] ^ (self.eight[at[some]] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
        at, left = begin + (size & ~3), size & 3
        for k in range(3):
            some = np.flatnonzero(left > k)
            h[some] = _turned(h[some] ^ self.data[at[some] + k].astype(np.uint64) * _P5, 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        h ^= h >> np.uint64(32)
        for i in np.flatnonzero(size >= 32).tolist():
            h[i] = xxhash.xxh64_intdigest(self.raw[begin[i] : begin[i] + size[i]])
        return h

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ranges of equal sizes that begin at ``a`` and ``b`` hold the same bytes."""
        out = np.ones(len(a), bool)
        some = np.flatnonzero(size <= 64)
        for k in range(0, 64, 8):
            some = some[size[some] > k]
            if not len(some):
                break
            spare = np.maximum(8 - (size[some] - k), 0).astype(np.uint64) * np.uint64(8)
            out[some] &= ((self.eight[a[some] + k] ^ self.eight[b[some] + k]) << spare) == 0
        for i in np.flatnonzero(size > 64).tolist():
            out[i] = self.raw[a[i] : a[i] + size[i]] == self.raw[b[i] : b[i] + size[i]]
        return out


def _crc_shifts(most: int) -> np.ndarray:
    """CRC-32 after so many zero bytes, by their number, a byte of the register and its value: the register is linear."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = (value >> np.uint32(1)) ^ np.where(value & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    out = np.empty((most + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None] << (np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None])
    for k in range(most):
        out[k + 1] = value[out[k] & np.uint32(255)] ^ (out[k] >> np.uint32(8))
    return out.reshape(-1)


_LONG = 64
_SHIFTS = _crc_shifts(_LONG)
_CRC_SPACE = np.uint32(zlib.crc32(b" "))


def _joined(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings in a row from those of both; the second has ``size`` bytes, ``_LONG`` at most."""
    at = size.astype(np.int64) * 1024
    out = b.copy()
    for k in range(4):
        out ^= _SHIFTS[at + (256 * k) + ((a >> np.uint32(8 * k)) & np.uint32(255))]
    return out


class SlotTable:
    """Open addressing with linear probing: ``owner`` is the occurrence that a slot was taken by, -1 where it is free.
    Slots store ``bucket`` and ``count``; ``slot`` is each occurrence's."""

    def __init__(self, found: Features, buckets: int, keys: np.ndarray | None = None):
        ranges, begin, size = found.ranges, found.begin, found.size
        keys = ranges.hashes(begin, size) if keys is None else keys
        mask = (1 << max(4, (2 * len(begin)).bit_length())) - 1
        self.owner = np.full(mask + 1, -1, np.int64)
        self.slot = (keys & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(begin))
        while len(left):
            at = self.slot[left]
            free = self.owner[at] < 0
            self.owner[at[free]] = left[free]  # of several that want it, one has it
            own = self.owner[at]
            equal = (keys[own] == keys[left]) & (size[own] == size[left])
            look = np.flatnonzero(equal & (own != left))
            equal[look] = ranges.same(begin[own[look]], begin[left[look]], size[left[look]])
            left = left[~equal]
            self.slot[left] = (self.slot[left] + 1) & mask
        self.count = np.bincount(self.slot, minlength=mask + 1)
        self.bucket = np.zeros(mask + 1, np.int64)
        taken = np.flatnonzero(self.count)
        self.bucket[taken] = self._crcs(found, self.owner[taken]) % buckets

    def _crcs(self, found: Features, owner: np.ndarray) -> np.ndarray:
        """CRC-32 of some features. Words are read once each; runs of them are joined from their words' values."""
        sizes, first, run = found.word_size, found.word[owner], found.run[owner]
        crc = np.zeros(len(found.begin), np.uint32)
        last = first + run - 1
        plain = (run > 1) & (sizes[np.minimum(first + 1, len(sizes) - 1)] <= _LONG) & (sizes[last] <= _LONG) if len(found.begin) >= len(sizes) and found.whole else np.zeros(len(owner), bool)
        alone, raw = owner[~plain], found.ranges.raw
        spans = zip(found.begin[alone].tolist(), (found.begin[alone] + found.size[alone]).tolist(), strict=True)
        crc[alone] = np.fromiter((zlib.crc32(raw[a:b]) for a, b in spans), np.uint32, len(alone))
        if plain.any():
            words = crc[self.owner[self.slot[: len(sizes)]]]  # single words come first
            spaced = _joined(words, np.full(len(words), _CRC_SPACE), np.ones(len(words), np.int64))
            pairs = _joined(spaced[:-1], words[1:], np.minimum(sizes[1:], _LONG))
            at = first[plain]
            value = pairs[at]
            three = run[plain] == 3
            end = at[three] + 2
            spaced = _joined(value[three], np.full(len(end), _CRC_SPACE), np.ones(len(end), np.int64))
            value[three] = _joined(spaced, words[end], sizes[end])
            crc[owner[plain]] = value
        return crc[owner].astype(np.int64)

    def bucket_counts(self, buckets: int) -> np.ndarray:
        taken = np.flatnonzero(self.count)
        out = np.zeros(buckets, np.int64)
        np.add.at(out, self.bucket[taken], self.count[taken])
        return out


@dataclass(frozen=True)
class Features:
    """Occurrences of runs of words in some texts: ranges of ``ranges``, and the text, first word and words of each.
    ``whole``: single words are all there, in order."""

    ranges: Ranges
    begin: np.ndarray
    size: np.ndarray
    text: np.ndarray
    word: np.ndarray
    run: np.ndarray
    word_size: np.ndarray
    whole: bool
    words: np.ndarray


def features(texts: list[bytes], longest: int, skip: int = 0) -> Features:
    """Runs of 1 to ``longest`` words, which one space joins. Runs within the first ``skip`` words are left out."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = _WORD[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    ends = np.cumsum(sizes + 1)  # past the zero that follows a text
    word = data > 0
    after = np.zeros(len(data), bool)
    after[1:] = word[:-1] & ~word[1:]
    data[after] = _SPACE
    kept = word | after
    text = np.searchsorted(ends, np.flatnonzero(after), "right")
    data = data[kept]
    stop = np.flatnonzero(after[kept])
    start = np.concatenate((np.zeros(min(1, len(stop)), np.int64), stop[:-1] + 1))
    begin, size, owner, first = [], [], [], []
    for k in range(min(longest, len(stop))):
        n = len(stop) - k
        inside = text[:n] == text[k:]
        inside[: max(skip - k, 0)] = False
        begin.append(start[:n][inside])
        size.append((stop[k:] - start[:n])[inside])
        owner.append(text[:n][inside])
        first.append(np.flatnonzero(inside))
    run = [np.full(len(x), k + 1) for k, x in enumerate(begin)]
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begin, size, owner, first, run)]
    return Features(Ranges(data), *joined, word_size=stop - start, whole=not skip and longest <= 3, words=np.bincount(text, minlength=len(texts)))


def pieces(text: bytes, longest: int, limit: int) -> Iterator[tuple[bytes, int]]:
    """A long text in pieces that end between words; each begins with the last words of the one before, so many of them,
    whose runs have been there."""
    at = skip = stop = 0
    while len(text) - at > limit:
        stop = _edge(text, max(at + limit, stop + 1))
        if stop is None:
            break
        yield text[at:stop], skip
        back, skip = stop, 0
        while skip < longest - 1 and back > at:
            back, skip = _word_before(text, back, at, skip)
        at = back
    yield text[at:], skip


def _edge(text: bytes, at: int, step: int = 4096) -> int | None:
    """First place from ``at`` on that is not in a word."""
    for a in range(at, len(text), step):
        out = np.flatnonzero(_WORD[np.frombuffer(text[a : a + step], np.uint8)] == 0)
        if len(out):
            return a + int(out[0])
    return None


def _word_before(text: bytes, at: int, floor: int, n: int) -> tuple[int, int]:
    """Beginning of the last word that ends at or before ``at``, and ``n + 1``; ``floor`` and ``n`` if there is none."""
    while at > floor and not _WORD[text[at - 1]]:
        at -= 1
    if at == floor:
        return floor, n
    while at > floor and _WORD[text[at - 1]]:
        at -= 1
    return at, n + 1


@dataclass(frozen=True)
class TargetResampling:
    """``percent`` of the texts of ``least`` words or more are drawn. ``slice`` bytes of text fill one table."""

    buckets: int = 10_000
    longest: int = 3
    percent: int = 5
    least: int = 20
    scale: int = 1000
    seed: int = 42
    slice: int = 1 << 20

    def _groups(self, texts: list[bytes | None]) -> Iterator[tuple[int, Features]]:
        """First text of each group of texts, and the group's features; a long text is a group, or several."""
        for a, b in text_slices(texts, self.slice):
            some = [x or b"" for x in texts[a:b]]
            long = [i for i, x in enumerate(some) if len(x) > self.slice]
            for i in long:
                for piece, skip in pieces(some[i], self.longest, self.slice):
                    found = features([piece], self.longest, skip)
                    found.words[:] -= skip
                    yield a + i, found
                some[i] = b""
            yield a, features(some, self.longest)

    def _table(self, found: Features) -> SlotTable:
        return SlotTable(found, self.buckets)

    def counts(self, texts: DataFrame) -> np.ndarray:
        """Features in each bucket over all ``text`` rows. A task sends a number for each bucket."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(self.buckets, np.int64)
            for batch in batches:
                for _, found in self._groups(strings(batch.column(0))):
                    total += self._table(found).bucket_counts(self.buckets)
            own = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bucket", "n"])

        rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long")
        found = rows.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(self.buckets, np.int64)
        out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
        return out

    def gains(self, every: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of a feature in each bucket, rounded down."""
        s, t = float(every.sum() + self.buckets), float(target.sum() + self.buckets)
        ratio = lambda a, b: math.floor(self.scale * math.log((b + 1.0) * s / ((a + 1.0) * t)))
        return np.array([ratio(a, b) for a, b in zip(every.tolist(), target.tolist(), strict=True)], np.int64)

    def weights(self, docs: DataFrame, gains: np.ndarray) -> DataFrame:
        """``doc_id, n_words, n_features, weight`` of each row."""
        shared = docs.sparkSession.sparkContext.broadcast(gains)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = strings(batch.column(1))
                out = np.zeros((3, len(texts)), np.int64)
                for a, found in self._groups(texts):
                    table, n = self._table(found), len(found.words)
                    gained = shared.value[table.bucket][table.slot]
                    out[0, a : a + n] += found.words
                    out[1, a : a + n] += np.bincount(found.text, minlength=n)
                    out[2, a : a + n] += np.bincount(found.text, gained, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], ["doc_id", "n_words", "n_features", "weight"])

        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")

    def sample(self, docs: DataFrame, targets: DataFrame) -> DataFrame:
        """``doc_id, n_words, n_features, weight, score, rank`` of each row of ``docs`` (``doc_id, text``).

        ``targets``: rows whose ``text`` is wanted. ``rank`` is the place of a drawn row by (score, smaller doc_id), null
        for others. A text without words (null, empty) has no features and weight 0. The noise is a function of the
        doc_id: a null id's is that of no digits and is smallest among equal scores; repeated rows have equal scores and
        ranks one after another. Texts of any length are read whole; other columns are ignored. Without targets all
        counts of theirs are 0; an empty table gives no rows.
        """
        rows = self.weights(docs, self.gains(self.counts(docs), self.counts(targets)))
        digest = F.sha2(F.concat(F.lit(f"{self.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
        h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
        noise = F.floor(-float(self.scale) * F.log(-F.log((h + 0.5) / F.lit(float(1 << 32)))))
        rows = keep(rows.withColumn("score", F.col("weight") + noise), "weights")
        able = F.col("n_words") >= self.least
        n = rows.where(able).count() * self.percent // 100
        ranked = running(rows.where(able).withColumn("one", F.lit(1).cast("long")), [], F.struct(-F.col("score"), "doc_id"), ["one"])
        rank = F.when(F.col("up_one") <= n, F.col("up_one"))
        return ranked.select(*rows.columns, rank.alias("rank")).unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))
