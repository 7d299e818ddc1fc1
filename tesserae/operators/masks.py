"""Connected parts of masks, their areas, holes and shapes. Masks are rows ``image, y, x`` of the cells that belong to them.

Tiles label their own cells; parts that meet at the edges of tiles are joined by links between labels, so that an image is
never in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import keep
from .linking import FEW, components
from .tiles import on_cells

_SIDE = 20  # bits of a row or column number


def _neighbours(connectivity: int) -> list[tuple[int, int]]:
    """Half of the neighbours of a cell: each pair of neighbours is met once."""
    return [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])


def _code(y: Column, x: Column) -> Column:
    """A label as a number: image, row and column of the smallest cell."""
    fits = (F.col("image") < 1 << 63 - 2 * _SIDE) & (F.greatest(y, x) < 1 << _SIDE) & (F.least(F.col("image"), y, x) >= 0)
    code = F.shiftleft(F.col("image").cast("long"), 2 * _SIDE) + F.shiftleft(y.cast("long"), _SIDE) + x
    return F.when(fits, code).otherwise(F.raise_error(F.lit("an image has over 2^20 rows or columns, or its number is too large")).cast("long"))


def label(cells: DataFrame, connectivity: int = 8, core: int = 64) -> DataFrame:
    """``image, y, x, part``: each cell with a number of its connected part, which is that of the part's first cell."""
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    steps = _neighbours(connectivity)

    def own(table: pa.Table) -> pa.Table:
        y, x, code = (table.column(c).to_numpy() for c in ("y", "x", "code"))
        place = np.full((core + 2, core + 2), -1)
        at = (y % core + 1, x % core + 1)
        place[at] = np.arange(len(y))
        pairs = [(i[i2 >= 0], i2[i2 >= 0]) for dy, dx in steps for i, i2 in ((np.arange(len(y)), place[at[0] + dy, at[1] + dx]),)]
        i, j = (np.concatenate(z) for z in zip(*pairs, strict=True))
        order = np.argsort(code)
        rank = np.empty(len(code), np.int64)
        rank[order] = np.arange(len(code))
        i, j, least = rank[i], rank[j], np.arange(len(code))
        while True:
            low, new = np.minimum(least[i], least[j]), least.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = np.minimum(new, new[least])
            if (new == least).all():
                break
            least = new
        return pa.table([table.column("image"), table.column("y"), table.column("x"), pa.array(code[order][least[rank]])], names=["image", "y", "x", "part"])

    y, x = F.col("y").cast("int"), F.col("x").cast("int")
    rows = cells.select(F.col("image").cast("long"), y.alias("y"), x.alias("x"), _code(y, x).alias("code"), F.floor(y / core).alias("ty"), F.floor(x / core).alias("tx"))
    tiles = keep(rows.groupBy("image", "ty", "tx").applyInArrow(own, "image long, y int, x int, part long"), "tile-parts")
    edge = lambda c: F.col(c) % core
    rim = tiles.where((edge("y") == 0) | (edge("x") == 0) | (edge("y") == core - 1) | (edge("x") == core - 1))
    step = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps]))
    sent = rim.select("image", "y", "x", "part", step.alias("s")).select("image", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.col("part").alias("u"))
    links = on_cells(sent, rim.withColumnRenamed("part", "v")).where("u <> v").select("u", "v")
    joined = components(links, FEW)
    out = tiles.join(joined.hint("merge"), tiles["part"] == joined["node"], "left")
    return out.select("image", "y", "x", F.coalesce("label", "part").alias("part"))


def areas(parts: DataFrame, *by: str) -> DataFrame:
    """``area`` of each part."""
    return parts.groupBy("image", *by, "part").agg(F.count("*").alias("area"))


def by_area(cells: DataFrame, least: int = 1, most: int | None = None, connectivity: int = 4) -> DataFrame:
    """Labelled cells of the parts of ``least`` to ``most`` cells."""
    parts = keep(label(cells, connectivity), "parts")
    sizes = areas(parts).where(F.col("area") >= least)
    return on_cells(parts, sizes if most is None else sizes.where(F.col("area") <= most), by=("image", "part")).select("image", "y", "x", "part", "area")


def holes(plane: DataFrame, mask: str, most: int | None = None) -> DataFrame:
    """Cells outside a mask whose part touches no edge of the image and has ``most`` cells, at most; 4-connected.

    ``plane``: sized images (``tiles.sized``) with a boolean column ``mask``.
    """
    empty = plane.where(~F.col(mask))
    parts = keep(label(empty.select("image", "y", "x"), 4), "background")
    border = (F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("x") == F.col("width") - 1)
    kinds = on_cells(parts, empty.select("image", "y", "x", border.alias("border"))).groupBy("image", "part").agg(F.count("*").alias("area"), F.bool_or("border").alias("border"))
    inner = kinds.where("NOT border") if most is None else kinds.where(~F.col("border") & (F.col("area") <= most))
    return on_cells(parts, inner, "left_semi", ("image", "part")).select("image", "y", "x")


def fill_holes(plane: DataFrame, mask: str, most: int | None = None) -> DataFrame:
    """``plane`` with holes of its mask filled."""
    found = holes(plane, mask, most).withColumn("hole", F.lit(True))
    return on_cells(plane, found, "left").withColumn(mask, F.col(mask) | F.col("hole").isNotNull()).drop("hole")


def shapes(parts: DataFrame, spacing: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Of each part: area, box, elongation (ratio of the axes of its second moments) and occupancy of its box.

    The eigenvalues of the 2 x 2 covariance are in closed form; of parts of one or two cells the box's sides count.
    """
    y, x = F.col("y") * spacing[0], F.col("x") * spacing[1]
    rows = parts.groupBy("image", "part").agg(
        F.count("*").alias("area"), (F.max("y") - F.min("y") + 1).alias("height"), (F.max("x") - F.min("x") + 1).alias("width"),
        F.var_samp(y).alias("yy"), F.var_samp(x).alias("xx"), F.covar_samp(y, x).alias("xy"),
    )
    middle, half = (F.col("yy") + F.col("xx")) / 2, F.sqrt(F.pow((F.col("yy") - F.col("xx")) / 2, 2) + F.pow("xy", 2))
    axes = F.sqrt((middle + half + 1e-6) / (F.greatest(middle - half, F.lit(0.0)) + 1e-6))
    long = F.when(F.col("area") >= 3, axes).otherwise(F.greatest("height", "width") / F.least("height", "width"))
    return rows.select("image", "part", "area", "height", "width", long.alias("elongation"), (F.col("area") / (F.col("height") * F.col("width"))).alias("occupancy"))


def elongated(cells: DataFrame, least: int, spacing: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Cells of the 4-connected parts that are long (1.7 times their width) or fill little (0.38) of a box of 5 or more."""
    parts = keep(label(cells, 4), "parts")
    fits = (F.col("area") >= least) & (F.greatest("height", "width") >= 5) & ((F.col("elongation") >= 1.7) | (F.col("occupancy") <= 0.38))
    return on_cells(parts, shapes(parts, spacing).where(fits), "left_semi", ("image", "part")).select("image", "y", "x")
