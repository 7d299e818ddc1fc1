"""One-to-one assignment of things that overlap, in the connected parts of their graph.

A pair whose sides meet nothing else is a match. The others are dealt out by the part of the graph that they are in, so that
a task holds a part, never an image; the parts of a partition are read one after another.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import keep
from .linking import FEW, components

#: A weight from 0 to 1 as a whole number, so that sums are exact.
_UNIT = 1 << 40


def best_pairs(t: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the chosen pairs: most pairs without a repeated side, and of these the largest total weight.

    Shortest augmenting paths with potentials: each left side in turn takes the cheapest path to a free right side, or to a
    place of its own or of a side on the path, which costs more than all pairs together and stands for no partner.
    """
    left, i = np.unique(t, return_inverse=True)
    right, j = np.unique(p, return_inverse=True)
    n, m = len(left), len(right)
    cost = np.rint((1.0 - weight) * _UNIT).astype(np.int64).tolist()
    order = np.argsort(i, kind="stable")
    begin = np.searchsorted(i[order], np.arange(n + 1)).tolist()
    column, edge = j[order].tolist(), order.tolist()
    alone = (n + 1) * _UNIT
    u, v = [0] * n, defaultdict(int)
    row_of: dict[int, int] = {}
    edge_of: dict[int, int] = {}
    for start in range(n):
        far: dict[int, int] = {}
        came: dict[int, tuple[int, int]] = {}
        done: dict[int, int] = {}
        heap: list[tuple[int, int]] = []
        row, base = start, 0
        while True:
            for k in range(begin[row], begin[row + 1] + 1):
                own = k == begin[row + 1]
                c, price, e = (m + row, alone, -1) if own else (column[k], cost[edge[k]], edge[k])
                d = base + price - u[row] - v[c]
                if c not in done and d < far.get(c, 1 << 200):
                    far[c], came[c] = d, (row, e)
                    heapq.heappush(heap, (d, c))
            while True:
                base, c = heapq.heappop(heap)
                if c not in done:
                    break
            if c not in row_of:
                break
            done[c] = base
            row = row_of[c]
        u[start] += base
        for k, d in done.items():
            v[k] += d - base
            u[row_of[k]] += base - d
        while True:
            row, e = came[c]
            before = next((k for k in done if row_of[k] == row), None) if row != start else None
            row_of[c], edge_of[c] = row, e
            if before is None:
                break
            c = before
    return np.array(sorted(e for e in edge_of.values() if e >= 0), np.int64)


def parts(pairs: DataFrame) -> DataFrame:
    """``pairs`` (``t, p``, numbers that no two images share) with ``part``: the smallest ``t`` that shared sides lead to."""
    least = keep(pairs.groupBy("p").agg(F.min("t").alias("v"), F.max("t").alias("w")).where("v < w").select("p", "v"), "shared-sides")
    label = components(pairs.join(least, "p").select(F.col("t").alias("u"), "v"), FEW)
    return pairs.join(label, pairs["t"] == label["node"], "left").withColumn("part", F.coalesce("label", "t")).drop("node", "label")


def by_part(rows: DataFrame, solve: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``solve`` of each part's rows. Parts are sorted within partitions, and one at a time is in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            part = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)] if len(part) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and held[0].column("part")[0].as_py() != part[a]:
                    yield from solve(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from solve(pa.Table.from_batches(held)).to_batches()

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


def assigned(pairs: DataFrame) -> DataFrame:
    """Of ``image, t, p, iou``, the pairs of a one-to-one match: most pairs, then largest total. Numbers of ``t`` and of
    ``p`` are of one image each. Repeated pairs count once; no pairs give no rows."""
    pairs = keep(pairs.select("image", "t", "p", "iou").dropDuplicates(["t", "p"]), "pairs")
    count = lambda k: pairs.groupBy(k).agg(F.count("*").alias(f"n_{k}"))
    pairs = pairs.join(count("t"), "t").join(count("p"), "p")
    free = (F.col("n_t") == 1) & (F.col("n_p") == 1)
    names = ["image", "t", "p", "iou"]

    def solve(table: pa.Table) -> pa.Table:
        chosen = best_pairs(*(table.column(c).to_numpy() for c in names[1:]))
        return table.take(pa.array(chosen)).select(names)

    met = parts(pairs.where(~free).select(names)).select(*names, "part")
    return pairs.where(free).select(names).unionByName(by_part(met, solve, "image long, t long, p long, iou double"))


def matching_changes(t: list[int], p: list[int], high: list[float], low: list[float]) -> dict[float, int]:
    """By how much the largest number of pairs without a repeated side changes as the threshold falls to each score; a pair
    is there at thresholds from ``high`` down to, and without, ``low``.

    Pairs that leave free their sides, and each free side then looks for an augmenting path.
    """
    events: dict[float, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    for k, (a, b) in enumerate(zip(high, low, strict=True)):
        events[a][0].append(k)
        events[b][1].append(k)
    near: dict[int, set[int]] = defaultdict(set)
    partner: dict[int, int] = {}
    right: dict[int, int] = {}
    out, now = {}, 0

    def augment(start: int) -> bool:
        came: dict[int, int] = {}
        queue = [start]
        for x in queue:
            for y in sorted(near[x]):
                if y in came:
                    continue
                came[y] = x
                if y not in right:
                    while True:
                        x = came[y]
                        before = partner.get(x)
                        partner[x], right[y] = y, x
                        if x == start:
                            return True
                        y = before
                queue.append(right[y])
        return False

    for level in sorted(events, reverse=True):
        added, gone = events[level]
        for k in gone:
            near[t[k]].discard(p[k])
            if partner.get(t[k]) == p[k]:
                del partner[t[k]], right[p[k]]
        for k in added:
            near[t[k]].add(p[k])
        for x in sorted(near):
            if x not in partner and near[x]:
                augment(x)
        if len(partner) != now:
            out[level], now = len(partner) - now, len(partner)
    return out


def match_changes(pairs: DataFrame, threshold: float) -> DataFrame:
    """``level, n``: by how much the number of matches over all images changes as the threshold falls to ``level``.

    ``pairs``: of ``component_tree.trees``. Over one half, no side has two partners at once and each pair is a match.
    """
    if threshold > 0.5:
        ends = F.explode(F.array(F.struct(F.col("high").alias("level"), F.lit(1).alias("n")), F.struct(F.col("low").alias("level"), F.lit(-1).alias("n"))))
        rows = pairs.select(ends.alias("e")).select("e.level", "e.n").where("level is not null")
        return rows.groupBy("level").agg(F.sum("n").alias("n"))

    def solve(table: pa.Table) -> pa.Table:
        t, p, high, low = (table.column(c).to_pylist() for c in ("t", "p", "high", "low"))
        found = matching_changes(t, p, high, [-np.inf if x is None else x for x in low])
        found.pop(-np.inf, None)
        return pa.table([pa.array(list(found), pa.float64()), pa.array(list(found.values()), pa.int64())], names=["level", "n"])

    rows = parts(keep(pairs.select("t", "p", "high", "low"), "tree-pairs")).select("t", "p", "high", "low", "part")
    return by_part(rows, solve, "level double, n long").groupBy("level").agg(F.sum("n").alias("n"))
