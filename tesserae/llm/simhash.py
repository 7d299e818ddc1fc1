"""Near-duplicate detection: SimHash fingerprints, compared bit plane by bit plane.

Fingerprints within ``radius`` bits agree on all but ``radius`` of any m blocks of bits, so that grouping them by every
choice of the other blocks brings each such pair together (m grows with the number of fingerprints, which keeps the
groups small). Inside a group the fingerprints stand vertically, as planes with one bit for each
fingerprint: 64 distances at a time grow in carry-save counters, and a block is given up once all its counters are past
the radius. A group gives the links of its spanning stars only, never all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.linking import components
from .common import hex64, keep, strings, word_lists

BITS = 64
#: XXH64's seed, which is also that of Spark's xxhash64.
SEED = 42


def fingerprint(data: bytes | None, shingle: int, lanes: int = 1) -> list[int]:
    """SimHash of the word shingles of a text in UTF-8, repeats included, in lanes of 64 bits; zero without words."""
    if not data:
        return [0] * lanes
    digest, counts, n, rest = xxhash.xxh64_intdigest, np.zeros((lanes, BITS), np.int64), 0, []
    for words in word_lists(data.lower()):
        words = rest + words
        for i in range(0, max(0, len(words) - shingle + 1), 1 << 16):
            some = words[i : i + (1 << 16) + shingle - 1]
            grams = list(map(b" ".join, zip(*(some[k:] for k in range(shingle)), strict=False)))
            for lane in range(lanes):
                hashes = np.array([digest(x, SEED + lane) for x in grams], "<u8")
                bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                counts[lane] += bits.sum(axis=0, dtype=np.int64)
            n += len(grams)
        rest = words[-(shingle - 1) :] if shingle > 1 else []
    if not n:
        return [digest(b" ".join(rest), SEED + lane) for lane in range(lanes)] if rest else [0] * lanes
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8").ravel().tolist()


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of some rows of lanes have each bit."""
    bits = np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Rows of lanes (a multiple of 64 rows) as planes of words, whose bit i is that of the word's i-th row."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def close_pairs(values: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of one group within ``radius`` bits.

    ``values``: fingerprints by lanes; group g holds ``values[starts[g]:starts[g + 1]]``.
    """
    place, ends = np.arange(len(values)), np.repeat(starts[1:], np.diff(starts))
    rows = np.zeros((-(-len(values) // 64) * 64, values.shape[1]), np.uint64)
    rows[: len(values)] = values
    planes = bit_planes(rows)
    # each fingerprint against the words that hold what follows it in its group, and of them against those places
    begin = (place + 1) // 64
    later = np.where(place + 1 < ends, (ends - 1) // 64 - begin + 1, 0)
    query = np.repeat(place, later)
    word = np.arange(len(query)) - np.repeat(np.cumsum(later) - later, later) + begin[query]
    low, high = np.maximum(query + 1 - 64 * word, 0), np.minimum(ends[query] - 64 * word, 64)
    every = ~np.uint64(0)
    mask = every << low.astype(np.uint64) & every >> (64 - high).astype(np.uint64)
    live = mask != 0
    query, word, mask = query[live], word[live], mask[live]
    width = max(1, int(radius).bit_length())  # counters begin so that radius + 1 carries out
    begin = (1 << width) - radius - 1
    counters = [np.full(len(query), ~np.uint64(0) if begin >> k & 1 else np.uint64(0), np.uint64) for k in range(width)]
    for k in range(len(planes)):
        asked = values[query, k // BITS] >> np.uint64(k % BITS) & np.uint64(1)
        carry = planes[k][word] ^ (np.uint64(0) - asked)
        for c, counter in enumerate(counters):
            counters[c], carry = counter ^ carry, counter & carry
        mask = mask & ~carry
        if k % 8 == 7:
            live = mask != 0
            query, word, mask = query[live], word[live], mask[live]
            counters = [x[live] for x in counters]
    left, right = [query[:0]], [query[:0]]
    for k in range(0, len(mask), 1 << 13):  # so that dense groups need no more memory than their pairs
        some = mask[k : k + (1 << 13)].astype("<u8").view(np.uint8).reshape(-1, 8)
        hit, bit = np.nonzero(np.unpackbits(some, axis=1, bitorder="little"))
        left.append(query[k + hit])
        right.append(word[k + hit] * 64 + bit)
    return np.concatenate(left), np.concatenate(right)


def stars(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` items along pairs (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[label])
        new = new[new]
        if (new == label).all():
            return label
        label = new


@dataclass(frozen=True)
class SimHash:
    """``shingle`` words; links at ``radius`` of 64 x ``lanes`` bits.

    Every link is found. Groups of over ``hot`` fingerprints are compared in blocks of that size; ``crowd``: how many chance may
    put into a group.
    """

    shingle: int = 4
    radius: int = 4
    lanes: int = 1
    hot: int = 1024
    crowd: int = 256

    @property
    def columns(self) -> list[str]:
        return [f"f{k}" for k in range(self.lanes)]

    def fingerprints(self, docs: DataFrame) -> DataFrame:
        """``doc_id, f0, f1, ...`` of each row; a null or empty text, or one without words, has zeros."""
        shingle, lanes, names = self.shingle, self.lanes, ["doc_id", *self.columns]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = np.array([fingerprint(x, shingle, lanes) for x in strings(batch.column(1))], np.uint64).reshape(-1, lanes)
                columns = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in found.T]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{x} long" for x in names))

    def masks(self, n: int) -> list[int]:
        """Bits that must agree, for each table of groups of n fingerprints: enough that chance puts few in a group."""
        width, wanted = BITS * self.lanes, math.log2(max(1, n / self.crowd))
        m = self.radius + 1
        while m < 12 and width * (m - self.radius) / m < wanted:
            m += 1
        edges = [width * k // m for k in range(m + 1)]
        blocks = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(m)]
        return [sum(x) for x in combinations(blocks, m - self.radius)]

    def _groups(self, n: int) -> F.Column:
        """The group of a fingerprint in each table."""
        lane = lambda mask, k: (x := mask >> BITS * k & (1 << BITS) - 1) - (x >> 63 << 64)
        key = lambda mask: [F.col(c).bitwiseAND(F.lit(lane(mask, k))) for k, c in enumerate(self.columns)]
        return F.array(*[F.xxhash64(F.lit(t), *key(mask)) for t, mask in enumerate(self.masks(n))])

    def links(self, nodes: DataFrame, n: int) -> DataFrame:
        """``u, v`` links of n ``node, f0, ...`` rows with distinct fingerprints; they span the same components as all
        pairs within the radius do."""
        members = nodes.select("node", *self.columns, F.explode(self._groups(n)).alias("g"))
        one = F.struct("node", *self.columns)
        large = members.groupBy("g").agg(F.count("*").alias("n"), F.min_by(one, F.xxhash64("node")).alias("pivot"))
        large = keep(large.where(F.col("n") > self.hot), "hot-groups")
        if large.isEmpty():
            blocks, star = members.select("*", *[F.lit(0).alias(c) for c in "sab"]), None
        else:
            blocks, star = self._crowds(members, large)
        blocks = blocks.select(F.xxhash64("g", "s", "a", "b").alias("g"), "node", *self.columns)
        spans = blocks.repartition("g").sortWithinPartitions("g", "node")
        found = spans.mapInArrow(_spanning(self.radius), "u long, v long")
        return found if star is None else found.unionByName(star)

    def _crowds(self, members: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Blocks of all groups, and the links to the pivots of the large ones.

        What is near a group's pivot is one component already; only what is apart from it must meet the whole group.
        Both kinds are dealt into parts of ``hot`` fingerprints, and each pair of parts that must meet is a block.
        """
        distance = reduce(lambda x, y: x + y, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"pivot.{c}"))) for c in self.columns])
        own = ["node", *self.columns]
        crowd = members.join(large, "g").select(*own, "g", F.col("pivot.node").alias("pivot"), (distance <= self.radius).alias("near"))
        crowd = keep(crowd, "crowd")
        parts = crowd.groupBy("g").agg(
            *[F.ceil(F.count_if(c) / self.hot).cast("int").alias(n) for c, n in ((F.col("near"), "i"), (~F.col("near"), "j"))]
        )
        crowd = crowd.join(keep(parts, "parts"), "g")
        part = F.pmod(F.xxhash64("node"), F.when(F.col("near"), F.col("i")).otherwise(F.col("j"))).cast("int")
        crowd = crowd.withColumn("p", part)
        numbers = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
        block = lambda rows, s, a, b: rows.select(*own, "g", F.lit(s).alias("s"), a.alias("a"), b.alias("b"))
        apart, p, o = crowd.where(~F.col("near")), F.col("p"), F.col("o")
        among = block(apart.withColumn("o", F.explode(numbers("j"))), 1, F.least(p, o), F.greatest(p, o))
        across = block(apart.withColumn("o", F.explode(numbers("i"))), 2, o, p)
        met = block(crowd.where("near").withColumn("o", F.explode(numbers("j"))), 2, p, o)
        small = block(members.join(large, "g", "left_anti"), 0, F.lit(0), F.lit(0))
        star = crowd.where(F.col("near") & (F.col("node") != F.col("pivot"))).select(F.col("node").alias("u"), F.col("pivot").alias("v"))
        return small.unionByName(among).unionByName(across).unionByName(met), star

    def components(self, docs: DataFrame) -> DataFrame:
        """``doc_id, fingerprint, component_id``, one row for each row of ``docs`` (``doc_id, text``; others are ignored).

        component_id is the smallest doc_id that links reach. Null, empty and wordless texts have fingerprint zero and
        link like any other; rows with a null doc_id take part and get their component's smallest id (null if it has
        none); repeated rows come out repeated; an empty table gives no rows.
        """
        fps = keep(self.fingerprints(docs), "fingerprints")
        distinct = fps.groupBy(*self.columns).agg(F.min("doc_id").alias("low"))
        distinct = keep(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct")
        label = keep(components(self.links(distinct.drop("low"), distinct.count())), "labels")
        root = keep(distinct.join(label, "node", "left").withColumn("root", F.coalesce("label", "node")), "roots")
        linked = root.where("label is not null").groupBy("root").agg(F.min("low").alias("component_id"))
        linked = keep(linked, "linked")
        of = root.join(linked, "root", "left").select(*self.columns, F.coalesce("component_id", "low").alias("component_id"))
        out = fps.join(keep(of, "component-of"), self.columns)
        digits = F.concat(*[hex64(F.col(c)) for c in self.columns])
        return out.select("doc_id", digits.alias("fingerprint"), "component_id")


def _spanning(radius: int, limit: int = 1 << 15):
    """Compares rows ``g, node, f0, ...``, sorted by group, many groups at once; gives the links of each group's stars."""

    def solve(rows: np.ndarray) -> pa.RecordBatch:
        starts = np.concatenate(([0], np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1, [len(rows)]))
        i, j = close_pairs(np.ascontiguousarray(rows[:, 2:]).view(np.uint64), starts, radius)
        label, node = stars(len(rows), i, j), rows[:, 1]
        moved = label != np.arange(len(rows))
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append(np.stack([x.to_numpy(zero_copy_only=False).astype(np.int64) for x in batch.columns], axis=1))
            size += batch.num_rows
            if size >= limit:
                rows = np.concatenate(parts)
                whole = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last group may go on
                if whole:
                    yield solve(rows[:whole])
                parts, size = [rows[whole:]], len(rows) - whole
        if size:
            yield solve(np.concatenate(parts))

    return run
