"""Component trees, assignment and FROC against plain versions."""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from tesserae.operators import assignment, component_tree, masks, matching
from tesserae.operators.component_tree import CELL, CHANGE, PAIR


def labelled(mask, connectivity):
    """Parts as sorted lists of cells."""
    left, out = {tuple(c) for c in np.argwhere(mask).tolist()}, []
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (connectivity == 8 or not (a and b))]
    while left:
        part, queue = set(), [left.pop()]
        while queue:
            y, x = queue.pop()
            part.add((y, x))
            for dy, dx in steps:
                if (y + dy, x + dx) in left:
                    left.remove((y + dy, x + dx))
                    queue.append((y + dy, x + dx))
        out.append(part)
    return out


def most_pairs(edges):
    near, partner = defaultdict(list), {}
    for t, p in edges:
        near[t].append(p)

    def found(t, seen):
        for p in near[t]:
            if p not in seen:
                seen.add(p)
                if p not in partner or found(partner[p], seen):
                    partner[p] = t
                    return True
        return False

    return sum(found(t, set()) for t in list(near))


def curve(target, score, overlap, least, connectivity):
    """Every distinct threshold, labelled anew."""
    true = [x for x in labelled(target, connectivity) if len(x) >= least]
    out = {}
    for value in np.unique(score[~np.isnan(score)]).tolist():
        called = [x for x in labelled(np.nan_to_num(score, nan=-1e9) >= value, connectivity) if len(x) >= least]
        edges = [(i, j) for i, t in enumerate(true) for j, p in enumerate(called) if t & p and len(t & p) >= overlap * len(t | p)]
        tp = most_pairs(edges)
        out[value] = (tp, len(called) - tp, len(true) - tp)
    return out


def in_rounds(target, score, overlap, least, connectivity, core):
    """The rounds of ``component_tree.trees`` without Spark; also the rows that the last round reads."""
    code = lambda c: c[0] << 20 | c[1]
    own = {c: (code(min(t)), len(t)) for t in labelled(target, connectivity) if len(t) >= least for c in t}
    limit = max(float(least), max([n for _, n in own.values()], default=0) // (overlap or 1.0) + 1)
    cells = [tuple(c) for c in np.argwhere(~np.isnan(score)).tolist()]
    height, width = (max(c[k] for c in cells) + 1 for k in (0, 1))
    rows = [
        {"kind": CELL, "image": 0, "height": height, "width": width, "y": c[0], "x": c[1], "code": code(c), "level": float(score[c]), "other": -1, "low": limit, "area": 1, "target": own.get(c, (-1, 0))[0], "target_area": own.get(c, (-1, 0))[1]}
        for c in cells
    ]
    side, left, read = core, [], 0
    types = pa.schema([(k, component_tree._TYPES[v]) for k, v in component_tree._COLUMNS.items()])
    fill = {"target": -1, "target_area": 0, "other": -1, "area": 0, "y": 0, "x": 0, "code": -1, "level": 0.0}
    while True:
        tiles, read = defaultdict(list), len(rows)
        for r in rows:
            tiles[r["y"] // side, r["x"] // side].append({k: fill.get(k) if v is None else v for k, v in r.items()})
        out = [r for some in tiles.values() for r in component_tree._tile(side, masks._neighbours(connectivity), overlap, least)(pa.Table.from_pylist(some, types)).to_pylist()]
        left += [r for r in out if r["kind"] >= CHANGE]
        rows = [r for r in out if r["kind"] < CHANGE]
        if side >= max(height, width):
            assert not rows
            return left, read
        side *= 2


@pytest.mark.parametrize("seed", range(60))
def test_tree_gives_every_threshold(seed):
    rng = np.random.default_rng(seed)
    shape, connectivity, core = rng.integers(3, 24, 2), int(rng.choice([4, 8])), int(rng.choice([2, 4, 8, 64]))
    overlap, least = float(rng.choice([0.0, 0.1, 0.3, 0.5, 0.6])), int(rng.choice([1, 1, 3]))
    score = rng.integers(0, int(rng.choice([3, 12, 500])), shape).astype(float)
    if seed % 2:  # slopes: long chains of nodes
        wide = np.pad(score, 1, mode="edge")
        score = np.round(sum(wide[a : a + shape[0], b : b + shape[1]] for a in range(3) for b in range(3)) / 9, 1)
    score[rng.random(shape) < 0.1] = np.nan
    target = rng.random(shape) < rng.choice([0.2, 0.5])
    rows, _ = in_rounds(target, score, overlap, least, connectivity, core)
    pairs = [r for r in rows if r["kind"] == PAIR]
    tp = assignment.matching_changes([r["target"] for r in pairs], [r["code"] for r in pairs], [r["level"] for r in pairs], [-np.inf if r["low"] is None else r["low"] for r in pairs])
    called = Counter()
    for r in rows:
        if r["kind"] == CHANGE:
            called[r["level"]] += r["area"]
    true = sum(len(x) >= least for x in labelled(target, connectivity))
    at = lambda changes, value: sum(n for level, n in changes.items() if level >= value)
    expected = curve(target, score, overlap, least, connectivity)
    assert {v: (at(tp, v), at(called, v) - at(tp, v), true - at(tp, v)) for v in expected} == expected


def test_what_goes_on_is_bounded_by_the_border():
    """A slope is one chain of as many nodes as cells; its large nodes go on as a few."""
    y, x = np.mgrid[:128, :128]
    score = (y * 128 + x).astype(float)
    target = np.zeros((128, 128), bool)
    target[3:5, 3:5] = True
    _, read = in_rounds(target, score, 0.5, 1, 8, 64)
    assert read < 3000


def frame(spark, image, **planes):
    first = next(iter(planes.values()))
    cells = [(image, i, j, *[None if isinstance(v[i, j], float) and np.isnan(v[i, j]) else v[i, j].item() for v in planes.values()]) for i in range(first.shape[0]) for j in range(first.shape[1])]
    kinds = ", ".join(f"{k} {'boolean' if v.dtype == bool else 'double'}" for k, v in planes.items())
    return spark.createDataFrame(cells, f"image long, y int, x int, {kinds}")


@pytest.mark.parametrize("overlap", [0.1, 0.6])
def test_froc_over_images(spark, monkeypatch, overlap):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(matching, "trees", lambda *a: component_tree.trees(*a, core=8))
    rows, expected, levels = None, [], set()
    for image in (3, 8):
        score, target = rng.integers(0, 6, (13, 18)).astype(float), rng.random((13, 18)) < 0.4
        score[0, :5] = np.nan
        one = frame(spark, image, score=score, t=target)
        rows = one if rows is None else rows.unionByName(one)
        expected.append(curve(target, score, overlap, 1, 8))
        levels |= set(expected[-1])
    images = rows.select("image").unionByName(spark.createDataFrame([(99,)], "image long"))  # one without cells
    got = matching.froc_curve(images, rows.where("t").select("image", "y", "x"), rows, overlap)
    total = {v: tuple(sum(e[v][k] for e in expected) for k in range(3)) for v in levels}
    assert {r.threshold: (r.tp, r.fp, r.fn) for r in got.collect()} == total
    assert {r.threshold: round(r.fp_per_image * 3) for r in got.collect()} == {v: x[1] for v, x in total.items()}
    some = matching.froc(images, rows.where("t").select("image", "y", "x"), rows, [2.5, 4.0, 77.0], overlap)
    assert {r.threshold: (r.tp, r.fp) for r in some.collect()} == {2.5: total[3.0][:2], 4.0: total[4.0][:2], 77.0: (0, 0)}
    none = rows.limit(0)
    assert matching.froc_curve(images, none.select("image", "y", "x"), none, overlap).count() == 0


def test_scores_that_are_no_numbers_are_refused(spark):
    rows = spark.createDataFrame([(0, 0, 0, float("nan"))], "image long, y int, x int, score double")
    with pytest.raises(Exception, match="not a number"):
        matching.froc_curve(rows, rows.select("image", "y", "x"), rows).collect()


@pytest.mark.parametrize("seed", range(40))
def test_pairs_are_most_and_then_best(seed):
    rng = np.random.default_rng(seed)
    for _ in range(20):
        n, m = rng.integers(1, 7, 2)
        edges = [(t + 5, p, float(rng.integers(1, 5) / 4 if seed % 2 else rng.random())) for t in range(n) for p in range(m) if rng.random() < 0.5]
        if not edges:
            continue
        weight = {(t, p): w for t, p, w in edges}
        got = [edges[k] for k in assignment.best_pairs(*map(np.array, zip(*edges, strict=True)))]
        assert len({t for t, _, _ in got}) == len({p for _, p, _ in got}) == len(got)
        side = list(range(max(n, m)))
        best = max((sum((t + 5, p) in weight for t, p in enumerate(deal)), sum(weight.get((t + 5, p), 0) for t, p in enumerate(deal))) for deal in permutations(side))
        assert (len(got), sum(w for *_, w in got)) == (best[0], pytest.approx(best[1]))


def test_assignment_of_a_hundred_thousand():
    """One connected part; sides that want the same few neighbours."""
    n = 100_000
    t = np.repeat(np.arange(n), 2)
    p = t + np.tile([0, 1], n)
    weight = np.where(np.arange(2 * n) % 2 == 1, 0.9, 0.5)
    chosen = assignment.best_pairs(t, p, weight)
    assert len(chosen) == n and weight[chosen].sum() == pytest.approx(0.9 * n)
    falling = assignment.best_pairs(t, p, weight[::-1])
    assert len(falling) == n


def test_assigned_parts(spark):
    rng = np.random.default_rng(2)
    rows = {(image, image * 1000 + int(t), image * 1000 + int(t + d)): float(rng.random()) for image in range(3) for t in rng.integers(0, 40, 60) for d in rng.integers(0, 3, 2)}
    pairs = spark.createDataFrame([(*k, w) for k, w in rows.items()], "image long, t long, p long, iou double").repartition(5)
    got = assignment.assigned(pairs).collect()
    t, p, w = (np.array(x) for x in zip(*[(t, p, w) for (_, t, p), w in rows.items()], strict=True))
    chosen = assignment.best_pairs(t, p, w)
    assert len({r.t for r in got}) == len({r.p for r in got}) == len(got) == len(chosen)
    assert sum(r.iou for r in got) == pytest.approx(w[chosen].sum()) and all(r.image == r.t // 1000 for r in got)
    assert assignment.assigned(pairs.limit(0)).count() == 0


def test_small_overlaps_take_the_deal_that_matches_most(spark):
    """The prediction that overlaps both targets goes to the one that has no other."""
    target, called = np.zeros((4, 20), bool), np.zeros((4, 20), bool)
    target[1, 0:8] = target[1, 9:13] = True
    called[1, 0:2] = called[1, 4:13] = True
    rows = frame(spark, 1, t=target, p=called)
    sides = [matching.instances(rows.where(c).select("image", "y", "x")) for c in "tp"]
    got = matching.instance_counts(rows, *sides, 0.1).collect()[0]
    assert (got.tp, got.fp, got.fn) == (2, 0, 0) and got.mean_iou == pytest.approx((2 / 8 + 4 / 9) / 2)
