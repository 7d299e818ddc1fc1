"""Masks, instances, lines and candidates against plain versions on whole arrays."""

from __future__ import annotations


import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import candidates, contours, distance, evaluation, grid, masks, matching, tiles


def frame(spark, *arrays, names=("v",), image=3):
    """Rows of arrays of one shape."""
    height, width = arrays[0].shape
    rows = [(image, y, x, *[a[y, x].item() for a in arrays]) for y in range(height) for x in range(width)]
    kinds = ["boolean" if a.dtype == bool else "double" for a in arrays]
    return spark.createDataFrame(rows, "image long, y int, x int, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def dense(df, column, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.y, r.x] = r[column]
    return out


def flood(mask, connectivity):
    """Parts of a mask, each named by its first cell."""
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    label = {}
    for start in zip(*np.nonzero(mask), strict=True):
        todo = [] if start in label else [start]
        while todo:
            at = todo.pop()
            if label.setdefault(at, start) is not start and at != start:
                continue
            for dy, dx in steps:
                to = (at[0] + dy, at[1] + dx)
                if 0 <= to[0] < mask.shape[0] and 0 <= to[1] < mask.shape[1] and mask[to] and to not in label:
                    label[to] = start
                    todo.append(to)
    return label


@pytest.mark.parametrize(("connectivity", "core"), [(4, 8), (8, 8), (8, 64)])
def test_parts_across_tiles(spark, connectivity, core):
    mask = np.random.default_rng(connectivity).random((37, 29)) < 0.5
    cells = frame(spark, mask, names=("m",)).where("m").select("image", "y", "x")
    got = {(r.y, r.x): (r.part >> 20 & (1 << 20) - 1, r.part & (1 << 20) - 1) for r in masks.label(cells, connectivity, core).collect()}
    assert got == {tuple(map(int, k)): tuple(map(int, v)) for k, v in flood(mask, connectivity).items()}
    assert masks.label(cells.limit(0)).count() == 0


def test_area_limits_scale_with_the_spacing(spark):
    """A small square goes and a large one stays, at two resolutions."""
    for scale in (1, 2):
        mask = np.zeros((32 * scale, 32 * scale), bool)
        mask[2 * scale : 4 * scale, 2 * scale : 4 * scale] = True
        mask[10 * scale : 14 * scale, 10 * scale : 14 * scale] = True
        least = int(np.ceil(12 * scale * scale))
        kept = masks.by_area(frame(spark, mask, names=("m",)).where("m").select("image", "y", "x"), least).collect()
        assert len(kept) == 16 * scale * scale and min(r.y for r in kept) == 10 * scale


def test_holes_touch_no_edge(spark):
    mask = np.ones((9, 9), bool)
    mask[2, 2] = mask[4, 4:6] = mask[0, 5] = False
    rows = tiles.sized(frame(spark, mask, names=("m",)))
    assert {(r.y, r.x) for r in masks.holes(rows, "m", 1).collect()} == {(2, 2)}
    assert {(r.y, r.x) for r in masks.holes(rows, "m").collect()} == {(2, 2), (4, 4), (4, 5)}
    assert masks.fill_holes(rows, "m").where("NOT m").count() == 1


def test_long_parts_stay(spark):
    mask = np.zeros((20, 20), bool)
    mask[3, 2:12] = True
    mask[10:16, 10:16] = True
    got = masks.elongated(frame(spark, mask, names=("m",)).where("m").select("image", "y", "x"), 5).collect()
    assert {r.y for r in got} == {3} and len(got) == 10


@pytest.mark.parametrize(("height", "width", "core"), [(40, 33, 8), (130, 20, 64), (3, 4, 64)])
def test_tiles_give_what_whole_images_do(spark, height, width, core, monkeypatch):
    values = np.random.default_rng(height).random((height, width))
    plane = tiles.sized(frame(spark, values))
    monkeypatch.setattr(tiles.on_tiles, "__defaults__", (core,))
    padded = np.pad(values, 2, mode="symmetric")
    around = np.lib.stride_tricks.sliding_window_view(padded, (5, 5))
    assert np.allclose(dense(tiles.local_moments(plane), "sd", values.shape), around.std(axis=(2, 3)), atol=1e-9)
    ring = np.pad(values, 1, mode="symmetric")
    gx = sum(w * (ring[1 + dy : 1 + dy + height, 2:] - ring[1 + dy : 1 + dy + height, :-2]) for dy, w in ((-1, 1), (0, 2), (1, 1))) / 8
    gy = sum(w * (ring[2:, 1 + dx : 1 + dx + width] - ring[:-2, 1 + dx : 1 + dx + width]) for dx, w in ((-1, 1), (0, 2), (1, 1))) / 8
    assert np.allclose(dense(tiles.gradient(plane), "magnitude", values.shape), np.hypot(gx, gy))
    mask = values > 0.6
    rows = tiles.sized(frame(spark, mask, names=("m",)))
    offsets, reach = tiles.disk(2), 2

    def spread(m, grow):
        wide = np.pad(m, reach)
        parts = [wide[reach + dy : reach + dy + height, reach + dx : reach + dx + width] for dy, dx in offsets]
        return np.any(parts, axis=0) if grow else np.all(parts, axis=0)

    assert (dense(tiles.morphology(rows, "m", offsets, "de"), "m", mask.shape) == spread(spread(mask, True), False)).all()
    assert (dense(tiles.morphology(rows, "m", offsets, "ed"), "m", mask.shape) == spread(spread(mask, False), True)).all()


def test_cells_outside_their_image_are_refused(spark):
    rows = frame(spark, np.ones((3, 3))).withColumns({"height": F.lit(2), "width": F.lit(3)})
    for df in (tiles.local_moments(rows), grid.in_patches(rows, 2, 1), grid.area_resample(rows, 1, 1)):
        with pytest.raises(Exception, match="outside its image"):
            df.collect()


def test_windows_cover_images_of_any_height(spark):
    for height in (30, 100, 217):
        rows = tiles.sized(frame(spark, np.ones((height, 6))))
        starts = sorted({r.y0 for r in grid.in_patches(rows, 32, 16).select("y0").collect()})
        assert starts == [0] if height <= 32 else starts[-1] == height - 32
        assert grid.in_patches(rows, 32, 16).select("y", "x").distinct().count() == height * 6


def test_instances_of_two_squares(spark):
    target, called = np.zeros((10, 10), bool), np.zeros((10, 10), bool)
    target[1:3, 1:3] = target[6:8, 6:8] = called[1:3, 1:3] = called[1:3, 7:9] = True
    rows = frame(spark, target, called, names=("t", "p"))
    sides = [matching.instances(rows.where(c).select("image", "y", "x")) for c in "tp"]
    got = matching.instance_counts(rows, *sides, 0.1).collect()[0]
    assert (got.tp, got.fp, got.fn, got.f1, got.mean_iou) == (1, 1, 1, 0.5, 1.0)
    none = sides[0].limit(0)
    empty = matching.instance_counts(rows, none, none).collect()[0]
    assert (empty.tp, empty.precision, empty.recall, empty.mean_iou) == (0, 1.0, 1.0, 1.0)


def test_false_positives_leave_as_the_threshold_grows(spark):
    target, score = np.zeros((8, 8), bool), np.zeros((8, 8))
    target[1:3, 1:3] = True
    score[1:3, 1:3], score[6, 6] = 0.9, 0.6
    rows = frame(spark, target, score, names=("t", "score"))
    got = {r.threshold: (r.tp, r.fp, r.fn, r.fp_per_image) for r in matching.froc(rows, rows.where("t").select("image", "y", "x"), rows, [0.5, 0.7], 0.5).collect()}
    assert got == {0.5: (1, 1, 0, 1.0), 0.7: (1, 0, 0, 0.0)}


@pytest.mark.parametrize("spacing", [(1.0, 1.0), (0.5, 2.0)])
def test_distances_are_euclidean(spark, spacing):
    rng = np.random.default_rng(8)
    shape, planes = (31, 47), {}
    for image, density in enumerate((0.0, 0.002, 0.05, 0.5, 1.0)):
        planes[image] = rng.random(shape) < density
    planes[1][30, 0] = True
    cells = spark.createDataFrame([(k, y, x, bool(v[y, x])) for k, v in planes.items() for y in range(shape[0]) for x in range(shape[1])], "image long, y int, x int, m boolean")
    every = np.argwhere(np.ones(shape)) * spacing
    for strip in (1, 100, 1 << 19):  # strips of one row, of two, and whole images
        found = {(r.image, r.y, r.x): r.distance for r in distance.nearest(cells, cells.where("m"), spacing, strip=strip).collect()}
        for image, points in planes.items():
            got = np.array([[found[image, y, x] for x in range(shape[1])] for y in range(shape[0])])
            if points.any():
                at = np.argwhere(points) * spacing
                assert np.allclose(got, np.sqrt(((every[:, None] - at[None]) ** 2).sum(axis=2)).min(axis=1).reshape(shape))
            else:
                assert np.isinf(got).all()
    some = cells.where("image = 3 AND y % 7 = 3 AND x > 20").unionByName(cells.where("image = 3 AND y = 3 AND x = 30"))  # a row that comes twice
    few = distance.nearest(some, cells.where("m"), spacing, strip=100).collect()
    assert len(few) == some.count() and all(found[r.image, r.y, r.x] == r.distance for r in few)
    assert distance.nearest(cells.limit(0), cells.where("m"), spacing).count() == 0


def test_the_lower_envelope_of_long_rows():
    rng = np.random.default_rng(5)
    heights = rng.integers(0, 3000, (3, 200)).astype(float) ** 2
    sites = np.sort(rng.choice(5000, 200, replace=False))
    row, x = np.repeat([0, 2], [700, 1]), np.concatenate((np.sort(rng.integers(0, 5000, 700)), [4999]))
    plain = (heights[row] + (x[:, None] - sites[None]) ** 2.0).min(axis=1)
    assert np.allclose(distance.least_parabola(heights, sites, row, x), plain)


@pytest.mark.parametrize(("core", "passes"), [(8, 1), (16, 2), (128, 8)])
def test_thinning_by_tiles_is_that_of_the_image(spark, core, passes):
    rng = np.random.default_rng(3)
    planes = [np.zeros((45, 40), bool), rng.random((33, 50)) < 0.8, np.zeros((40, 40), bool), np.ones((20, 37), bool)]
    planes[0][10:30, 5:36] = True
    planes[2][7:9, :] = planes[2][:, 15:17] = True  # lines along the borders of tiles
    cells = [(k, y, x, bool(v[y, x])) for k, v in enumerate(planes) for y in range(v.shape[0]) for x in range(v.shape[1])]
    rows = tiles.sized(spark.createDataFrame(cells, "image long, y int, x int, m boolean"))
    got = contours.skeleton(rows, "m", passes, core).collect()
    assert len(got) == len(cells)
    for k, mask in enumerate(planes):
        line = contours.thinned(mask)
        assert {(r.y, r.x) for r in got if r.image == k and r.line} == {tuple(c) for c in np.argwhere(line).tolist()}
    assert not contours.skeleton(rows.withColumn("m", F.lit(False)), "m").where("line").count()


def test_thinning_leaves_lines():
    bar = np.zeros((11, 20), bool)
    bar[3:8, 2:18] = True
    line = contours.thinned(bar)
    assert (line <= bar).all() and line.sum(axis=0).max() == 1 and 10 <= line.sum() < 16 and set(np.nonzero(line)[0]) <= {4, 5, 6}
    assert (contours.thinned(line) == line).all() and len(set(flood(line, 8).values())) == 1
    blob = np.random.default_rng(9).random((40, 40)) < 0.6
    assert len(set(flood(contours.thinned(blob), 8).values())) == len(set(flood(blob, 8).values()))


def test_a_wider_prediction_has_the_same_centre_line(spark):
    target, called = np.zeros((11, 11), bool), np.zeros((11, 11), bool)
    target[2:9, 5] = called[2:9, 4:7] = True
    rows = tiles.sized(frame(spark, target, called, np.ones((11, 11), bool), names=("t", "p", "v")))
    got = contours.centerline_metrics(rows, "t", "p", "v", 2.0).collect()[0]
    assert got.f1 >= 0.8 and got.cl_dice >= 0.8
    whole = evaluation.evaluate(rows, "t", "p", "v", pixel_area=2.0).collect()[0]
    assert (whole.pixel.tp, whole.pixel.fp, whole.burden.true_area, whole.burden.absolute_area_error) == (7, 14, 14.0, 28.0)
    assert whole.instance.tp == 1 and whole.boundary.recall == 1.0


def test_ignored_regions_make_no_boundary(spark):
    mask, valid = np.ones((7, 7), bool), np.ones((7, 7), bool)
    valid[:, 4:] = False
    rows = tiles.sized(frame(spark, mask, valid, names=("mask", "valid")))
    got = dense(tiles.boundary(rows), "edge", (7, 7)).astype(bool)
    expected = np.zeros((7, 7), bool)
    expected[:, 0] = expected[0, :3] = expected[6, :3] = True
    assert (got == expected).all()


def test_a_dark_fold_and_a_gap_are_found(spark):
    rng = np.random.default_rng(2)
    rgb = np.clip(np.stack([np.full((64, 64), v) for v in (0.75, 0.55, 0.75)]) + rng.normal(0, 0.01, (3, 64, 64)), 0, 1)
    rgb[:, :, 20:24] = np.array([0.25, 0.1, 0.3])[:, None, None]
    rgb[:, 40:43, 32:56] = 0.995
    found = candidates.both(frame(spark, *rgb, names=("r", "g", "b")))
    fold, crack = dense(found, "fold", (64, 64)) > 0, dense(found, "crack", (64, 64)) > 0
    assert fold[:, 20:24].mean() > 0.8 and fold[:, 30:].mean() < 0.05
    assert crack[40:43, 34:54].mean() > 0.5 and crack[:30].mean() < 0.02 and not (fold & crack).any()
    assert (dense(found, "review", (64, 64)) >= fold).all()


def test_windows_of_a_cell_by_division(spark):
    for height, size, stride in ((30, 32, 16), (100, 32, 24), (101, 32, 24), (128, 32, 32), (40, 8, 13), (33, 32, 5)):
        rows = spark.range(height).select(F.lit(0).alias("image"), F.col("id").cast("int").alias("y"), F.lit(0).alias("x"), F.lit(height).alias("height"), F.lit(1).alias("width"))
        starts = [0] if height <= size else sorted({*range(0, height - size + 1, stride), height - size})
        got = {(r.y, r.y0) for r in grid.in_patches(rows, size, stride).collect()}
        assert got == {(y, s) for y in range(height) for s in starts if s <= y < s + size}
