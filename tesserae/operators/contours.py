"""Lines of masks: distances between two sets of cells, thinning, and metrics of boundaries and centre lines.

No task holds an image: distances go by columns and strips of rows, thinning by tiles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import ratio
from ..storage import keep
from . import tiles
from .distance import nearest


def thinned(mask: np.ndarray, passes: int | None = None) -> np.ndarray:
    """Skeleton by alternating thinning passes, so many at most: border cells go whose removal parts nothing, until none does."""
    now = np.pad(mask.astype(bool), 1)
    while passes is None or passes > 0:
        passes = None if passes is None else passes - 1
        before = now.copy()
        for odd in (False, True):
            n, e, s, w = now[:-2, 1:-1], now[1:-1, 2:], now[2:, 1:-1], now[1:-1, :-2]
            ring = np.stack([n, now[:-2, 2:], e, now[2:, 2:], s, now[2:, :-2], w, now[:-2, :-2]]).astype(np.int8)
            count = ring.sum(axis=0)
            turns = ((ring == 0) & (np.roll(ring, -1, axis=0) == 1)).sum(axis=0)
            free = ~(n & e & w) & ~(n & s & w) if odd else ~(n & e & s) & ~(e & s & w)
            now[1:-1, 1:-1] &= ~((count >= 2) & (count <= 6) & (turns == 1) & free)
        if (now == before).all():
            break
    return now[1:-1, 1:-1]


def skeletons(plane: DataFrame, masks: list[str], passes: int = 8, core: int = 128) -> DataFrame:
    """``image, y, x``, ``line_<mask>`` and ``was_<mask>``, the mask itself, for the cells of sized images that a line holds.

    A double pass looks two cells far. An image that is one tile is thinned to its end at once. Of the others, tiles take a halo
    of two cells for each of ``passes`` double passes and do these in rounds, until a round changes nothing; only the cells that
    are left go on.
    """
    lines, was, old = ([f"{k}_{m}" for m in masks] for k in ("line", "was", "old"))

    def kernel(arrays: dict[str, np.ndarray], halo: int) -> dict[str, np.ndarray]:
        inside, cut = arrays["inside"], (slice(halo, -halo),) * 2
        alone = inside.sum() == inside[cut].sum()
        out = {x: thinned(arrays[x] > 0, None if alone else passes)[cut] for x in lines}
        return out | {x: arrays[x][cut] > 0 for x in was} | {o: arrays[x][cut] > 0 for o, x in zip(old, lines, strict=True)} | {x: arrays[x][cut] for x in ("tall", "wide")}

    some, kinds = " OR ".join(lines), dict.fromkeys(lines + was + old, "boolean") | {"tall": "int", "wide": "int"}
    rows = plane.select("image", "y", "x", F.col("height").alias("tall"), F.col("width").alias("wide"), *[F.coalesce(F.col(m), F.lit(False)).alias(x) for m, x in zip(masks, lines, strict=True)])
    rows, ready = rows.where(some).select("*", *[F.col(x).alias(w) for x, w in zip(lines, was, strict=True)]), None
    while True:
        rows = rows.select("*", F.col("tall").alias("height"), F.col("wide").alias("width"))
        found = keep(tiles.on_tiles(rows, kernel, 2 * passes, dict.fromkeys(lines + was + ["tall", "wide"], 0), kinds, core), "thin")
        out, large = found.where(some).select("image", "y", "x", *lines, *was), F.greatest("tall", "wide") > core
        if found.where(large).where(" OR ".join(f"{o} <> {x}" for o, x in zip(old, lines, strict=True))).isEmpty():
            return out if ready is None else ready.unionByName(out)
        if ready is None:
            ready = found.where(~large).where(some).select(*out.columns)
        rows = found.where(large).where(some).drop(*old)


def skeleton(plane: DataFrame, mask: str, passes: int = 8, core: int = 128) -> DataFrame:
    """``image, y, x, line`` for each cell of sized images with a boolean column ``mask``."""
    keys = ["image", "y", "x"]
    left = skeletons(plane, [mask], passes, core).select(*keys, F.lit(True).alias("line"))
    return tiles.on_cells(plane.select(*keys), left, "left").withColumn("line", F.coalesce("line", F.lit(False)))


def distances(plane: DataFrame, target: str, prediction: str, spacing: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """``image, side, distance``: of each marked cell of a side to the nearest of the other (infinite without any)."""
    marked = keep(plane.select("image", "y", "x", F.col(target).alias("a"), F.col(prediction).alias("b")).where("a OR b"), "marked")
    one = lambda own, other, side: nearest(marked.where(own).withColumn("side", F.lit(side)), marked.where(other), spacing, ("side",))
    return one("a", "b", "target").unionByName(one("b", "a", "prediction")).select("image", "side", "distance")


def edge_distance(plane: DataFrame, mask: str, spacing: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """``image, y, x, distance`` of each cell of an image to the nearest of its cells outside ``mask``."""
    return nearest(plane, plane.where(~F.col(mask)), spacing)


def harmonic(a: Column, b: Column) -> Column:
    return F.when(a + b > 0, 2 * a * b / (a + b)).otherwise(0.0)


def match_metrics(plane: DataFrame, target: str, prediction: str, tolerance: float, spacing: tuple[float, float] = (1.0, 1.0), images: DataFrame | None = None) -> DataFrame:
    """Of each image (of ``images``, if given): cells of both sides, the shares within ``tolerance`` of the other, their harmonic mean, the mean distance
    and the 95th percentile of all distances (null where a side is empty; 0 where both are)."""
    rows, side = distances(plane, target, prediction, spacing), F.col("side")
    near = lambda k: F.count_if((side == k) & (F.col("distance") <= tolerance))
    found = rows.groupBy("image").agg(
        F.count_if(side == "target").alias("n_target"), F.count_if(side == "prediction").alias("n_predicted"), near("target").alias("hit_target"),
        near("prediction").alias("hit_predicted"), F.avg("distance").alias("assd"), F.percentile("distance", F.lit(0.95)).alias("hd95"),
    )
    out = (plane if images is None else images).select("image").distinct().join(found, "image", "left").na.fill(0, ["n_target", "n_predicted", "hit_target", "hit_predicted"])
    precision, recall = ratio(F.col("hit_predicted"), F.col("n_predicted"), 1.0), ratio(F.col("hit_target"), F.col("n_target"), 1.0)
    some = lambda c: F.when((F.col("n_target") > 0) & (F.col("n_predicted") > 0), F.col(c)).when((F.col("n_target") == 0) & (F.col("n_predicted") == 0), 0.0)
    return out.select("image", "n_target", "n_predicted", precision.alias("precision"), recall.alias("recall"), harmonic(precision, recall).alias("f1"), some("assd").alias("assd"), some("hd95").alias("hd95"))


def boundary_metrics(plane: DataFrame, target: str, prediction: str, valid: str, tolerance: float = 2.0, spacing: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Match metrics of the boundaries of two masks of sized images."""
    rows = plane.select("image", "y", "x", "height", "width", target, prediction, valid)
    return match_metrics(tiles.boundaries(rows, [target, prediction], valid), f"edge_{target}", f"edge_{prediction}", tolerance, spacing, plane)


def centerline_metrics(plane: DataFrame, target: str, prediction: str, valid: str, tolerance: float = 2.0, spacing: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Match metrics of the skeletons of two masks of sized images, and ``cl_dice``: of the shares of each skeleton that the
    other mask holds."""
    rows = plane.select("image", "y", "x", "height", "width", *[(F.col(c) & F.col(valid)).alias(c) for c in (target, prediction)])
    lines = skeletons(rows, [target, prediction])
    held = lambda line, mask: ratio(F.count_if(F.col(f"line_{line}") & F.col(f"was_{mask}")), F.count_if(f"line_{line}"), 1.0)
    dice = lines.groupBy("image").agg(harmonic(held(prediction, target), held(target, prediction)).alias("cl_dice"))
    found = match_metrics(lines, f"line_{target}", f"line_{prediction}", tolerance, spacing, plane).join(dice, "image", "left")
    return found.withColumn("cl_dice", F.coalesce("cl_dice", F.lit(1.0)))  # two empty lines agree
