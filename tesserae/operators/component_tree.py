"""Component trees: the connected parts of a score map at every threshold, each named once.

Cells join by falling score. A node is a part between two scores: it is born at its own score, and at the next lower score
at which it grows its parent takes its place. Tiles build the trees of their own cells. A node that reaches no border of its
tile is whole, and leaves; the others go on, four tiles at a time, and are joined by the cells that meet at the borders.
Nodes with more cells than matter keep their place in the tree only, and chains of these are one node, so that what goes on
is bounded by the length of the border, not by the area within.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import keep
from .masks import _SIDE, _code, _neighbours

#: What rows of a round are: cells (first round only), open nodes, their target cells, border cells; then what leaves:
#: changes of the number of parts at a score, and pairs of a part and a target.
CELL, NODE, HELD, BORDER, CHANGE, PAIR = range(6)
_COLUMNS = {"kind": "int", "image": "long", "height": "int", "width": "int", "y": "int", "x": "int", "code": "long", "level": "double", "other": "long", "low": "double", "area": "long", "target": "long", "target_area": "long"}
_TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


@dataclass
class _Nodes:
    """Atoms (cells or open nodes) that are joined into nodes; atoms of a node have its level."""

    code: list[int]
    level: list[float]
    area: list[int]
    held: list[dict[int, int]]
    border: list[bool]
    parent: list[int] = field(default_factory=list)

    def join(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Joins atoms by falling level along edges ``a, b``. Gives the node of each atom, and sets the nodes' parents."""
        n, level = len(self.code), self.level
        weights = np.minimum(*(np.asarray(level, float)[x] for x in (a, b))) if len(a) else np.zeros(0)
        order = np.argsort(-weights, kind="stable")
        root, top, same, self.parent = list(range(n)), list(range(n)), list(range(n)), [-1] * n
        size = [1] * n
        for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            while root[j] != j:
                root[j] = root[root[j]]
                j = root[j]
            if i == j:
                continue
            if size[i] < size[j]:
                i, j = j, i
            p, q = top[i], top[j]
            if level[p] > level[q]:
                p, q = q, p
            if level[p] == level[q]:  # one node
                same[q] = p
                self.area[p] += self.area[q]
                self.border[p] |= self.border[q]
                self.code[p] = min(self.code[p], self.code[q])
                _add(self.held, p, q)
            else:
                self.parent[q] = p
            root[j], top[i] = i, p
            size[i] += size[j]
        for i in range(n):
            x = i
            while same[x] != x:
                same[x] = same[same[x]]
                x = same[x]
            same[i] = x
        self.parent = [same[x] if x >= 0 else -1 for x in self.parent]
        return same


def _add(held: list[dict[int, int]], into: int, other: int) -> None:
    """The smaller is put into the larger."""
    if len(held[into]) < len(held[other]):
        held[into], held[other] = held[other], held[into]
    own = held[into]
    for k, v in held[other].items():
        own[k] = own.get(k, 0) + v
    held[other] = {}


class _Rows:
    def __init__(self, image: int, height: int, width: int):
        self.fixed = {"image": image, "height": height, "width": width}
        self.columns: dict[str, list] = {x: [] for x in _COLUMNS if x not in self.fixed}

    def put(self, **values) -> None:
        for name, column in self.columns.items():
            column.append(values.get(name))

    def table(self) -> pa.Table:
        n = len(self.columns["kind"])
        return pa.table({name: pa.array([self.fixed[name]] * n if name in self.fixed else self.columns[name], _TYPES[kind]) for name, kind in _COLUMNS.items()})


def _edges(y: np.ndarray, x: np.ndarray, steps: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places of neighbours among some cells."""
    key = (y + 1 << _SIDE + 1) + x + 1
    order = np.argsort(key)
    sorted_key, out = key[order], []
    for dy, dx in steps:
        wanted = (y + 1 + dy << _SIDE + 1) + x + 1 + dx
        at = np.minimum(np.searchsorted(sorted_key, wanted), len(key) - 1)
        found = np.flatnonzero(sorted_key[at] == wanted)
        out.append((found, order[at[found]]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def _round(table: pa.Table, side: int, steps: list[tuple[int, int]], overlap: float, least: int) -> pa.Table:
    """One tile of ``side`` cells, from its cells or from the open nodes of its four parts."""
    column = {name: table.column(name).to_numpy() for name in ("kind", "y", "x", "code", "level", "other", "area", "target", "target_area")}
    kind, rows = column["kind"], _Rows(*(table.column(c)[0].as_py() for c in ("image", "height", "width")))
    height, width = rows.fixed["height"], rows.fixed["width"]
    limit = math.inf if overlap == 0 else table.column("low")[0].as_py()
    target_area = {int(t): int(a) for t, a in zip(column["target"], column["target_area"], strict=True) if a > 0}
    inner = CELL if (kind == CELL).any() else NODE
    atoms = np.flatnonzero(kind == inner)
    nodes = _Nodes(column["code"][atoms].tolist(), column["level"][atoms].tolist(), column["area"][atoms].tolist(), [{} for _ in atoms], [False] * len(atoms))
    place = {c: i for i, c in enumerate(nodes.code)}
    if inner == CELL:
        y, x, owner = column["y"][atoms], column["x"][atoms], np.arange(len(atoms))
        a, b = _edges(y, x, steps)
        for i, t in enumerate(column["target"][atoms].tolist()):
            if t >= 0:
                nodes.held[i][t] = 1
    else:
        for i in np.flatnonzero(kind == HELD).tolist():
            nodes.held[place[int(column["code"][i])]][int(column["target"][i])] = int(column["area"][i])
        some = np.flatnonzero(kind == BORDER)
        y, x = column["y"][some], column["x"][some]
        owner = np.array([place[c] for c in column["code"][some].tolist()], np.int64)
        a, b = _edges(y, x, steps) if len(some) else (np.zeros(0, np.int64),) * 2
        half = side // 2
        apart = (y[a] // half != y[b] // half) | (x[a] // half != x[b] // half)
        inside = [(i, place[p]) for i, p in enumerate(column["other"][atoms].tolist()) if p >= 0]
        own = np.array(inside, np.int64).reshape(-1, 2)
        a, b = np.concatenate((owner[a[apart]], own[:, 0])), np.concatenate((owner[b[apart]], own[:, 1]))
    rim = lambda at, size: ((at % side == 0) & (at > 0)) | ((at % side == side - 1) & (at < size - 1))
    border = rim(y, height) | rim(x, width)
    for i in owner[border].tolist():
        nodes.border[i] = True
    same = nodes.join(a, b)
    own = [i for i, s in enumerate(same) if i == s]
    own.sort(key=lambda i: -nodes.level[i])
    parent, level, area = nodes.parent, nodes.level, nodes.area
    opened, changes = list(nodes.border), defaultdict(int)
    total, children, heir = area.copy(), [0] * len(same), [-1] * len(same)
    for i in own:  # parents come after their children
        p = parent[i]
        if opened[i]:
            if p >= 0:
                opened[p] = True
                total[p] += total[i]
                children[p] += 1
                heir[p] = i
            continue
        if area[i] >= least:
            changes[level[i]] += 1
            if p >= 0:
                changes[level[p]] -= 1
        if least <= area[i] <= limit:
            for t, n in nodes.held[i].items():
                if n >= overlap * (area[i] + target_area[t] - n):
                    rows.put(kind=PAIR, code=nodes.code[i], level=level[i], low=level[p] if p >= 0 else None, area=n, other=area[i], target=t, target_area=target_area[t])
        if p >= 0:
            area[p] += area[i]
            total[p] += area[i]
            if total[p] > limit:
                nodes.held[p] = {}
            else:
                _add(nodes.held, p, i)
    for value, n in changes.items():
        if n:
            rows.put(kind=CHANGE, level=value, area=n)
    left = [i for i in own if opened[i]]
    gone = [False] * len(same)
    for i in left:  # a large node with one large open child and no cell at the border stands for nothing of its own
        p = parent[i]
        gone[i] = p >= 0 and not nodes.border[i] and children[i] == 1 and total[heir[i]] > limit
        if gone[i]:
            area[p] += area[i]
    for i in left:
        if gone[i]:
            continue
        p = parent[i]
        while p >= 0 and gone[p]:
            p = parent[p]
        heavy = total[i] > limit
        rows.put(kind=NODE, code=nodes.code[i], level=level[i], other=nodes.code[p] if p >= 0 else -1, area=area[i], low=limit, y=int(y[0]), x=int(x[0]))
        for t, n in ({} if heavy else nodes.held[i]).items():
            rows.put(kind=HELD, code=nodes.code[i], target=t, area=n, target_area=target_area[t], low=limit, y=int(y[0]), x=int(x[0]))
    for i, cy, cx in zip(owner[border].tolist(), y[border].tolist(), x[border].tolist(), strict=True):
        rows.put(kind=BORDER, code=nodes.code[same[i]], y=cy, x=cx, low=limit)
    return rows.table()


def _tile(side: int, steps: list[tuple[int, int]], overlap: float, least: int) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _round(table, side, steps, overlap, least)


def trees(scored: DataFrame, target: DataFrame, overlap: float, least: int = 1, connectivity: int = 8, core: int = 64) -> tuple[DataFrame, DataFrame]:
    """Of the parts of ``score >= threshold`` at every threshold: ``changes`` and ``pairs``.

    ``scored``: ``image, y, x, score`` (cells without a score are left out; NaN is an error); ``target``: labelled cells with
    areas (``matching.instances``). ``changes``: ``image, level, n``, by how much the number of parts of ``least`` cells or more
    changes when the threshold falls to ``level``. ``pairs``: ``image, t, p, high, low, iou`` of parts that overlap a target by
    ``overlap`` or more, at thresholds from ``high`` down to, and without, ``low`` (null: at all lower ones).
    """
    if not 0 <= overlap <= 1:
        raise ValueError("overlap is between zero and one")
    steps = _neighbours(connectivity)
    y, x, score = F.col("y").cast("int"), F.col("x").cast("int"), F.col("score").cast("double")
    checked = F.when(F.isnan(score), F.raise_error(F.lit("a score is not a number")).cast("double")).otherwise(score + F.lit(0.0))
    cells = scored.where("score is not null").select(F.col("image").cast("long"), y.alias("y"), x.alias("x"), checked.alias("level"))
    held = target.select("image", "y", "x", F.col("part").alias("target"), F.col("area").cast("long").alias("target_area"))
    # a part that has over the largest target's area / overlap cells overlaps none by as much
    sizes = target.groupBy("image").agg(F.max("area").alias("largest"))
    limit = F.greatest(F.lit(float(least)), F.floor(F.coalesce("largest", F.lit(0)) / (overlap or 1.0)) + 1.0)
    spans = cells.groupBy("image").agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"))
    spans = keep(spans.join(sizes, "image", "left").select("image", "height", "width", limit.cast("double").alias("low")), "tree-images")
    none = lambda kind: F.lit(None).cast(kind)
    given = {"kind": F.lit(CELL), "code": _code(F.col("y"), F.col("x")), "other": none("long"), "area": F.lit(1), "target": F.coalesce("target", F.lit(-1)), "target_area": F.coalesce("target_area", F.lit(0))}
    state = cells.join(held, ["image", "y", "x"], "left").join(spans, "image")
    state = state.select(*[given.get(name, F.col(name)).cast(kind).alias(name) for name, kind in _COLUMNS.items()])
    most = spans.agg(F.max(F.greatest("height", "width"))).first()[0] or 0
    side, leaving = core, []
    while True:
        at: list[Column] = [F.floor(F.col(c) / side).alias(f"t{c}") for c in "yx"]
        numbers = {"target": -1, "target_area": 0, "other": -1, "area": 0, "y": 0, "x": 0, "code": -1, "level": 0.0}
        done = state.na.fill(numbers).groupBy("image", *at).applyInArrow(_tile(side, steps, overlap, least), ", ".join(f"{k} {v}" for k, v in _COLUMNS.items()))
        done = keep(done, "tree-round")
        leaving.append(done.where(F.col("kind") >= CHANGE))
        if side >= most:
            break
        state, side = done.where(F.col("kind") < CHANGE), side * 2
    every = leaving[0]
    for x in leaving[1:]:
        every = every.unionByName(x)
    changes = every.where(F.col("kind") == CHANGE).groupBy("image", "level").agg(F.sum("area").alias("n"))
    iou = F.col("area") / (F.col("other") + F.col("target_area") - F.col("area"))
    pairs = every.where(F.col("kind") == PAIR).select("image", F.col("target").alias("t"), F.col("code").alias("p"), F.col("level").alias("high"), "low", iou.alias("iou"))
    return changes, pairs
