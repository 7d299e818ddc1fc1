"""Neighbourhood operators of images, tile by tile.

An image is rows ``image, y, x`` with values. Each cell goes to its tile, and to those whose halo it lies in: border cells
only are sent twice. A tile is a small array in a task, and gives the rows of its core.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Array = np.ndarray
#: Padded arrays by name, and the halo, to arrays of the core.
Kernel = Callable[[dict[str, Array], int], dict[str, Array]]


def sized(plane: DataFrame) -> DataFrame:
    """Images with their ``height`` and ``width``."""
    sizes = plane.groupBy("image").agg((F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"))
    return plane.join(sizes, "image")


def on_cells(left: DataFrame, right: DataFrame, how: str = "inner", by: tuple[str, ...] = ("image", "y", "x")) -> DataFrame:
    """Join of rows of the same images, by cell or by part. A file of cells is a small part of what its rows take in memory, so
    that Spark would broadcast sides that it thinks small: the join is told to sort and merge them."""
    return left.join(right.hint("merge"), list(by), how)


def on_tiles(plane: DataFrame, kernel: Kernel, halo: int, pads: dict[str, str | float], out: dict[str, str], core: int = 64) -> DataFrame:
    """``image, y, x`` and what ``kernel`` gives, by column name and type, for each cell of sized images.

    ``pads``: the columns that it takes, and what stands outside the image: a constant, or "symmetric" for its mirror.
    The array ``inside`` is one where the image is. Cells that an image lacks are 0.
    """
    tile = lambda at, length: F.sequence(
        F.floor(F.greatest(F.col(at) - halo, F.lit(0)) / core).cast("int"), F.floor(F.least(F.col(at) + halo, F.col(length) - 1) / core).cast("int")
    )
    bad = (F.col("y") < 0) | (F.col("x") < 0) | (F.col("y") >= F.col("height")) | (F.col("x") >= F.col("width"))
    rows = plane.withColumn("outside", F.when(bad, F.raise_error(F.lit("a cell is outside its image"))))
    rows = rows.withColumn("ty", F.explode(tile("y", "height"))).withColumn("tx", F.explode(tile("x", "width")))
    columns = list(pads)

    def run(table: pa.Table) -> pa.Table:
        first = {x: table.column(x)[0].as_py() for x in ("height", "width", "ty", "tx")}
        edges, before = [], []
        for at, length in (("ty", "height"), ("tx", "width")):
            begin, end = first[at] * core, min((first[at] + 1) * core, first[length])
            low, high = max(0, begin - halo), min(first[length], end + halo)
            edges.append((low, high, begin, end))
            before.append((low - (begin - halo), end + halo - high))
        y, x = (table.column(c).to_numpy() - e[0] for c, e in zip("yx", edges, strict=True))
        shape = tuple(e[1] - e[0] for e in edges)
        arrays = {"inside": np.pad(np.ones(shape), before)}
        for name, pad in pads.items():
            dense = np.zeros(shape)
            dense[y, x] = table.column(name).to_numpy().astype(np.float64)
            arrays[name] = np.pad(dense, before, mode="symmetric") if pad == "symmetric" else np.pad(dense, before, constant_values=pad)
        found = kernel(arrays, halo)
        y, x = y + edges[0][0] - edges[0][2], x + edges[1][0] - edges[1][2]
        own = (y >= 0) & (x >= 0) & (y < edges[0][3] - edges[0][2]) & (x < edges[1][3] - edges[1][2])
        y, x, some = y[own], x[own], table.filter(pa.array(own))
        kinds = {"boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32()}
        values = [pa.array(found[k][y, x], kinds[kind]) for k, kind in out.items()]
        return pa.table([some.column("image"), some.column("y"), some.column("x"), *values], names=["image", "y", "x", *out])

    schema = "image long, y int, x int, " + ", ".join(f"{k} {kind}" for k, kind in out.items())
    casts = [F.col("image").cast("long"), *[F.col(c).cast("int").alias(c) for c in ("y", "x", "height", "width", "ty", "tx")], *[F.col(c).cast("double").alias(c) for c in columns]]
    return rows.where("outside is null").select(*casts).groupBy("image", "ty", "tx").applyInArrow(run, schema)


def _windows(array: Array, reach: int, halo: int) -> Array:
    """Square windows of a padded array around each cell of its core."""
    trim = halo - reach
    array = array[trim : array.shape[0] - trim, trim : array.shape[1] - trim]
    return np.lib.stride_tricks.sliding_window_view(array, (2 * reach + 1, 2 * reach + 1))


def local_moments(plane: DataFrame, value: str = "v", reach: int = 2) -> DataFrame:
    """``mean`` and standard deviation ``sd`` of the square around each cell; images are mirrored at their edges."""

    def kernel(arrays: dict[str, Array], halo: int) -> dict[str, Array]:
        around = _windows(arrays[value], reach, halo)
        mean = around.mean(axis=(2, 3))
        return {"mean": mean, "sd": np.sqrt(np.maximum((around * around).mean(axis=(2, 3)) - mean * mean, 0))}

    return on_tiles(plane, kernel, reach, {value: "symmetric"}, {"mean": "double", "sd": "double"})


def gradient(plane: DataFrame, value: str = "v") -> DataFrame:
    """Sobel ``magnitude``, over 8; images are mirrored at their edges."""
    smooth, slope = np.array([1, 2, 1]), np.array([-1, 0, 1])

    def kernel(arrays: dict[str, Array], halo: int) -> dict[str, Array]:
        around = _windows(arrays[value], 1, halo)
        gy = np.einsum("yxab,a,b->yx", around, slope, smooth) / 8
        gx = np.einsum("yxab,a,b->yx", around, smooth, slope) / 8
        return {"magnitude": np.hypot(gy, gx)}

    return on_tiles(plane, kernel, 1, {value: "symmetric"}, {"magnitude": "double"})


def disk(radius: float, spacing: tuple[float, float] | None = None) -> list[tuple[int, int]]:
    """Offsets within ``radius``, in cells or in the unit of ``spacing``; always the cell itself."""
    sy, sx = spacing or (1.0, 1.0)
    ry, rx = math.floor(radius / sy + 1e-9), math.floor(radius / sx + 1e-9)
    offsets = [(y, x) for y in range(-ry, ry + 1) for x in range(-rx, rx + 1) if (y * sy) ** 2 + (x * sx) ** 2 <= radius * radius + 1e-9]
    return offsets or [(0, 0)]


def square(reach: int) -> list[tuple[int, int]]:
    return [(y, x) for y in range(-reach, reach + 1) for x in range(-reach, reach + 1)]


def _spread(array: Array, offsets: list[tuple[int, int]], grow: bool) -> Array:
    """Any (or all) of the cells at some offsets; a border as wide as the farthest offset is lost."""
    reach = max(max(abs(y), abs(x)) for y, x in offsets)
    height, width = array.shape[0] - 2 * reach, array.shape[1] - 2 * reach
    parts = (array[reach + y : reach + y + height, reach + x : reach + x + width] for y, x in offsets)
    out = next(parts).copy()
    for part in parts:
        out = out | part if grow else out & part
    return out


def morphology(plane: DataFrame, mask: str, offsets: list[tuple[int, int]], steps: str = "d", outside: int = 0) -> DataFrame:
    """``image, y, x, mask`` after dilations (d) and erosions (e), which see ``outside`` beyond the image.

    A closing is "de", an opening "ed".
    """
    reach = max(max(abs(y), abs(x)) for y, x in offsets)
    halo = reach * len(steps)
    turned = [(-y, -x) for y, x in offsets]

    def kernel(arrays: dict[str, Array], halo: int) -> dict[str, Array]:
        now, inside, trim = arrays[mask] > 0, arrays["inside"] > 0, 0
        for step in steps:
            now = _spread(now, turned if step == "d" else offsets, step == "d")
            trim += reach
            within = inside[trim : inside.shape[0] - trim, trim : inside.shape[1] - trim]
            now = np.where(within, now, bool(outside))
        return {mask: now}

    return on_tiles(plane, kernel, halo, {mask: outside}, {mask: "boolean"})


def boundary(plane: DataFrame, mask: str = "mask", valid: str = "valid") -> DataFrame:
    """``image, y, x, edge``: cells of a mask with one of their eight neighbours outside it, or outside the image.

    Cells next to an invalid one are left out, as the mask ends there for another reason.
    """
    return boundaries(plane, [mask], valid).withColumnRenamed(f"edge_{mask}", "edge")


def boundaries(plane: DataFrame, masks: list[str], valid: str = "valid") -> DataFrame:
    """``image, y, x`` and ``edge_<mask>`` of some masks, in one pass."""

    def kernel(arrays: dict[str, Array], halo: int) -> dict[str, Array]:
        known = _spread(arrays[valid] > 0, square(1), False)
        out = {}
        for mask in masks:
            own = (arrays[mask] > 0) & (arrays[valid] > 0)
            out[f"edge_{mask}"] = own[1:-1, 1:-1] & ~_spread(own, square(1), False) & known
        return out

    return on_tiles(plane, kernel, 1, {**dict.fromkeys(masks, 0), valid: 1}, {f"edge_{m}": "boolean" for m in masks})


def weighted(plane: DataFrame, value: str, offsets: list[tuple[int, int]]) -> DataFrame:
    """``image, y, x, density``: mean over the offsets, with zeros beyond the image."""
    reach = max(max(abs(y), abs(x)) for y, x in offsets)

    def kernel(arrays: dict[str, Array], halo: int) -> dict[str, Array]:
        around = _windows(arrays[value], reach, halo)
        return {"density": sum(around[:, :, reach + y, reach + x] for y, x in offsets) / len(offsets)}

    return on_tiles(plane, kernel, reach, {value: 0}, {"density": "double"})


def highest(plane: DataFrame, value: str, offsets: list[tuple[int, int]]) -> DataFrame:
    """``image, y, x, high``: the largest value at the offsets; images are mirrored at their edges."""
    reach = max(max(abs(y), abs(x)) for y, x in offsets)

    def kernel(arrays: dict[str, Array], halo: int) -> dict[str, Array]:
        around = _windows(arrays[value], reach, halo)
        return {"high": np.maximum.reduce([around[:, :, reach + y, reach + x] for y, x in offsets])}

    return on_tiles(plane, kernel, reach, {value: "symmetric"}, {"high": "double"})

