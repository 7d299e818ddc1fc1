"""Near copies: texts that share most of their word shingles, by SimHash fingerprints and then by the shingles themselves.

Texts meet where a band of min-hashes agrees, which takes the same number of bands for any number of texts, as texts that
share no shingles agree in none. In a group that met, the fingerprints are compared by bit planes and carry-save counters
(``simhash.close_pairs``); what is within the radius forms cells, and a cell compares whole shingle sets. Links are such
verified pairs only, and as many as span what they connect.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.linking import components
from .common import keep, strings, word_lists
from .simhash import bit_counts, close_pairs, stars

_FACTOR = 0x9E3779B97F4A7C15


class Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, 11)
        return value


def _mixed(hashes: np.ndarray) -> np.ndarray:
    for multiplier in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        hashes = (hashes ^ hashes >> np.uint64(30)) * np.uint64(multiplier)
    return hashes ^ hashes >> np.uint64(31)


def shingle_set(data: bytes | None, shingle: int, known: Words) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text in UTF-8, lower-cased; a shorter text is one shingle."""
    words = [np.zeros(0, np.uint64)]
    for some in word_lists((data or b"").decode("utf-8", "replace").lower().encode()):
        words.append(np.fromiter(map(known.__getitem__, some), np.uint64, len(some)))
    words = np.concatenate(words)
    size = min(shingle, len(words))
    hashes, factor = np.full(len(words) - size + 1, size, np.uint64), 1
    for k in range(size):
        hashes += words[k : k + len(hashes)] * np.uint64(factor)
        factor = factor * _FACTOR % (1 << 64)
    return np.unique(_mixed(hashes).view(np.int64))


def alike(a: np.ndarray, b: np.ndarray, over: int, under: int) -> bool:
    """Whether two sorted sets share ``over`` / ``under`` of their union."""
    need = (len(a) + len(b)) * over
    if min(len(a), len(b)) * (over + under) < need:
        return False
    at = np.searchsorted(a, b)
    return int(np.count_nonzero(a[np.minimum(at, len(a) - 1)] == b)) * (over + under) >= need


@dataclass(frozen=True)
class NearCopies:
    """Links texts that share ``over`` / ``under`` of the distinct shingles of both, of ``shingle`` words each.

    ``bands`` of ``rows`` min-hashes: a pair at similarity s meets with chance 1 - (1 - s^rows)^bands, 0.99 at 0.8 and
    more above it. ``radius`` of 64 x ``lanes`` bits: at 0.8 a pair differs in 39 bits, with a deviation of 5.7. Groups of over
    ``hot`` texts are dealt into parts.
    """

    shingle: int = 5
    over: int = 4
    under: int = 5
    rows: int = 5
    bands: int = 12
    lanes: int = 4
    radius: int = 64
    hot: int = 512
    memo: int = 300_000

    @property
    def columns(self) -> list[str]:
        return [f"f{k}" for k in range(self.lanes)]

    def signature(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprint, by lanes, and bands of a shingle set."""
        hashes, count = hashes.view(np.uint64), self.rows * self.bands
        lanes = np.arange(1, self.lanes + 1, dtype=np.uint64) * np.uint64(_FACTOR)
        factors = _mixed(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1)
        least = np.full(count, ~np.uint64(0))
        ones = np.zeros(64 * self.lanes, np.int64)
        for i in range(0, len(hashes), 4096):
            some = hashes[i : i + 4096, None]
            least = np.minimum(least, (some * factors).min(axis=0))
            ones += bit_counts(_mixed(some ^ lanes))
        bands = np.zeros(self.bands, np.uint64)
        for k in range(self.rows):
            bands = _mixed(bands + least[k :: self.rows] * np.uint64(_FACTOR))
        return np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8"), bands.view(np.int64)

    def _sets(self, rows: DataFrame, column, schema: str) -> DataFrame:
        """``column(node, shingle sets)`` of ``node, text`` rows, in batches."""
        shingle, memo = self.shingle, self.memo

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Words()
            for batch in batches:
                for begin in range(0, batch.num_rows, 500):
                    part, sets = batch.slice(begin, 500), []
                    for text in strings(part.column(1)):
                        sets.append(shingle_set(text, shingle, known))
                        if len(known) > memo:
                            known.clear()
                    yield column(part.column(0), sets)

        return rows.mapInArrow(run, schema)

    def signatures(self, rows: DataFrame) -> DataFrame:
        """``node, f0, ..., bands`` of ``node, text`` rows."""
        signature, names = self.signature, ["node", *self.columns, "bands"]

        def column(node: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
            found = [signature(x) for x in sets]
            lanes = np.array([x for x, _ in found]).T
            bands = pa.array([x for _, x in found], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([node, *map(pa.array, map(np.ascontiguousarray, lanes)), bands], names)

        return self._sets(rows, column, ", ".join(f"{x} long" for x in names[:-1]) + ", bands array<long>")

    def shingle_sets(self, rows: DataFrame) -> DataFrame:
        """``node, hashes`` of ``node, text`` rows."""

        def column(node: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([node, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], ["node", "hashes"])

        return self._sets(rows, column, "node long, hashes array<long>")

    def _cells(self, members: DataFrame) -> DataFrame:
        """``cell, node, f0, ...``: what is connected within the radius in a group ``g``; pairs of one ``label`` do not count.

        A cell is named by its nodes, so that the same nodes in several groups are one.
        """
        radius, names = self.radius, ["cell", "node", *self.columns]

        def solve(rows: np.ndarray) -> pa.RecordBatch:
            starts = np.concatenate(([0], np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1, [len(rows)]))
            i, j = close_pairs(np.ascontiguousarray(rows[:, 3:]).view(np.uint64), starts, radius)
            apart = rows[i, 2] != rows[j, 2]
            i, j = i[apart], j[apart]
            label = stars(len(rows), i, j)
            some = np.unique(np.concatenate((i, j)))
            some = some[np.argsort(label[some], kind="stable")]
            first = np.flatnonzero(np.concatenate(([True], label[some][1:] != label[some][:-1]))[: len(some)])
            cell = np.zeros(0, np.uint64)
            if len(some):
                cell = np.repeat(np.add.reduceat(_mixed(rows[some, 1].view(np.uint64)), first), np.diff(np.concatenate((first, [len(some)]))))
            columns = [cell.view(np.int64), *rows[some][:, [1, *range(3, rows.shape[1])]].T]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names)

        spans = members.select("g", "node", "label", *self.columns).repartition("g").sortWithinPartitions("g", "node")
        return spans.mapInArrow(_whole_groups(solve), ", ".join(f"{x} long" for x in names)).distinct()

    def _verified(self, cells: DataFrame, rows: DataFrame) -> DataFrame:
        """``u, v`` links that span the pairs of each cell within the radius whose sets are alike."""
        over, under, radius, lanes = self.over, self.under, self.radius, self.lanes
        cells = keep(cells, "cells")
        need = keep(cells.select("node").distinct(), "cell-nodes")
        sets = keep(self.shingle_sets(rows.join(need, "node", "left_semi")), "cell-sets")

        def links(node: np.ndarray, prints: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
            i, j = close_pairs(prints, np.array([0, len(node)]), radius)
            away = np.bitwise_count(prints[i] ^ prints[j]).sum(axis=1)
            root = list(range(len(node)))

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            order = np.argsort(away, kind="stable")
            for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
                x, y = top(a), top(b)
                if x != y and alike(sets[a], sets[b], over, under):
                    root[max(x, y)] = min(x, y)
                    yield int(node[a]), int(node[b])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, node, prints, sets, out = None, [], [], [], []

            def solve() -> None:
                if len(node) > 1:
                    out.extend(links(np.array(node), np.array(prints, np.int64).view(np.uint64), sets))

            for batch in batches:
                names, nodes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = np.stack([batch.column(k + 2).to_numpy(zero_copy_only=False) for k in range(lanes)], axis=1)
                for k in range(batch.num_rows):
                    if names[k] != name:
                        solve()
                        name, node, prints, sets = names[k], [], [], []
                    node.append(nodes[k])
                    prints.append(rows[k])
                    sets.append(batch.column(lanes + 2)[k].values.to_numpy())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["u", "v"])
                    out = []
            solve()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["u", "v"])

        spans = cells.join(sets, "node").select("cell", "node", *self.columns, "hashes").repartition("cell").sortWithinPartitions("cell", "node")
        return keep(spans.mapInArrow(run, "u long, v long"), "alike")

    def _pivots(self, crowd: DataFrame) -> DataFrame:
        """``g, pivot``: the member nearest to the majority of the bits of about 64 members of each hot group, ``g, n``."""
        names = ["g", *[f"m{k}" for k in range(self.lanes)]]

        def solve(rows: np.ndarray) -> pa.RecordBatch:
            starts = np.concatenate(([0], np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1))
            sizes = np.diff(np.concatenate((starts, [len(rows)])))
            bits = np.unpackbits(np.ascontiguousarray(rows[:, 1:]).view(np.uint8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            middle = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<i8")
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (rows[starts, 0], *middle.T)], names)

        few = crowd.where(F.pmod(F.xxhash64("node", F.lit(1)), F.greatest(F.lit(1), F.floor(F.col("n") / 64))) == 0).select("g", *self.columns)
        middle = few.repartition("g").sortWithinPartitions("g").mapInArrow(_whole_groups(solve), ", ".join(f"{x} long" for x in names))
        away = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"m{k}"))) for k, c in enumerate(self.columns)), F.lit(0))
        one = F.struct("node", *self.columns)
        return crowd.join(keep(middle, "middles"), "g").groupBy("g").agg(F.min_by(one, F.struct(away, "node")).alias("pivot"))

    def links(self, rows: DataFrame) -> DataFrame:
        """``u, v`` verified links of ``node, text`` rows (distinct nodes)."""
        signed = keep(self.signatures(rows), "signatures")
        members = signed.select("node", *self.columns, F.posexplode("bands").alias("band", "value"))
        members = members.select(F.xxhash64("band", "value").alias("g"), "node", *self.columns)
        large = keep(members.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > self.hot), "hot-groups")
        alone = F.col("node").alias("label")
        if large.isEmpty():
            return self._verified(self._cells(members.withColumn("label", alone)), rows)
        crowd = keep(members.join(large, "g"), "crowd")
        parts = F.ceil(F.col("n") / self.hot).cast("int")
        pivots = keep(self._pivots(crowd).join(large, "g"), "pivots")
        # each part of a hot group meets the group's pivot, which joins the parts
        dealt = crowd.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
        own = [F.xxhash64("g", "part").alias("g"), "node", alone, *self.columns]
        centre = pivots.select("g", "pivot.*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        small = members.join(large, "g", "left_anti").select("g", "node", alone, *self.columns)
        met = small.unionByName(dealt.select(own)).unionByName(centre.select(own).join(dealt.select(own), ["g", "node"], "left_anti"))
        first = self._verified(self._cells(met), rows)
        # what the pivot's component has not reached meets the whole group
        label = keep(components(first), "first-labels")
        crowd = crowd.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
        middle = pivots.select("g", F.col("pivot.node").alias("node")).join(label, "node", "left").select("g", F.coalesce("label", "node").alias("centre"))
        crowd = keep(crowd.drop("n").join(keep(middle, "centres"), "g").withColumn("near", F.col("label") == F.col("centre")), "labelled-crowd")
        counts = crowd.groupBy("g").agg(*[F.ceil(F.count_if(c) / self.hot).cast("int").alias(x) for c, x in ((F.col("near"), "i"), (~F.col("near"), "j"))])
        crowd = crowd.join(keep(counts.where("j > 0"), "counts"), "g")
        crowd = crowd.withColumn("p", F.pmod(F.xxhash64("node"), F.when(F.col("near"), F.col("i")).otherwise(F.col("j"))).cast("int"))
        numbers = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
        block = lambda df, s, a, b: df.select(F.xxhash64("g", F.lit(s), a, b).alias("g"), "node", "label", *self.columns)
        apart, p, o = crowd.where(~F.col("near")), F.col("p"), F.col("o")
        blocks = block(apart.withColumn("o", F.explode(numbers("j"))), 1, F.least(p, o), F.greatest(p, o))
        blocks = blocks.unionByName(block(apart.withColumn("o", F.explode(numbers("i"))), 2, o, p))
        blocks = blocks.unionByName(block(crowd.where("near").withColumn("o", F.explode(numbers("j"))), 2, p, o))
        return first.unionByName(self._verified(self._cells(blocks), rows))

    def drop(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` (``doc_id, text`` and any others) but, of each group of linked texts, all save that with the
        smallest doc_id (ids that are null come last; of rows that repeat an id, any).

        Null, empty and wordless texts are alike; repeated rows are copies; an empty table gives no rows.
        """
        every = keep(docs.select(F.struct(*docs.columns).alias("doc")).withColumn("node", F.monotonically_increasing_id()), "rows")
        label = keep(components(self.links(every.select("node", "doc.text"))), "near-labels")
        rows = every.select("node", F.col("doc.doc_id").cast("long").alias("doc_id")).join(label, "node")
        rank = F.struct(F.col("doc_id").isNull(), "doc_id", "node")
        rows = keep(rows.select("node", "label", rank.alias("rank")), "near-rows")
        stay = keep(rows.groupBy("label").agg(F.min("rank").alias("first")).select("first.node"), "near-stay")
        return every.join(rows.select("node").join(stay, "node", "left_anti"), "node", "left_anti").select("doc.*")


def _whole_groups(solve, limit: int = 1 << 13):
    """Calls ``solve`` with rows of longs, sorted by the first column, many whole groups at once."""

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
