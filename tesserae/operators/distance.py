"""Exact Euclidean distances to the nearest marked cell, in two passes, neither of which sees a whole image.

Down the columns, each mark covers the rows up to the next one, by a window over a column's marks. Across the rows, a strip
of rows takes for each of its cells the least of the parabolas that stand on the columns. Their lower envelope meets the
columns in order, so that the cells of a row are halved and each looks between what its neighbours found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a strip.
STRIP = 1 << 19


def least_parabola(heights: np.ndarray, sites: np.ndarray, row: np.ndarray, x: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """The least of ``heights[row, j] + (scale * (x - sites[j])) ** 2`` over j, for cells that are sorted by row and x."""
    n, wide = len(row), len(sites)
    count = np.bincount(row, minlength=len(heights))
    place = np.arange(n) - (np.cumsum(count) - count)[row]
    out, best = np.zeros(n), np.zeros(n, np.int64)
    stride = 1 << int(count.max(initial=0)).bit_length()
    while stride:
        some = np.flatnonzero((place + 1) % (2 * stride) == stride)
        if len(some):
            low = np.where(place[some] >= stride, best[some - stride], 0)
            high = np.where(place[some] + stride < count[row[some]], best[np.minimum(some + stride, n - 1)], wide - 1)
            size = high - low + 1
            begin = np.cumsum(size) - size
            j = np.arange(size.sum()) - np.repeat(begin - low, size)
            owner = np.repeat(some, size)
            cost = heights[row[owner], j] + (scale * (x[owner] - sites[j])) ** 2
            least = np.minimum.reduceat(cost, begin)
            out[some] = least
            best[some] = np.minimum.reduceat(np.where(cost == np.repeat(least, size), j, wide), begin)
        stride >>= 1
    return out


def _strip(table: pa.Table, spacing: tuple[float, float], others: list[str]) -> pa.Table:
    """One strip of rows: marks with the next one of their column, and the cells that ask."""
    asked = table.column("asked").to_numpy(zero_copy_only=False)
    y, x = (table.column(c).to_numpy() for c in ("y", "x"))
    some, marks = np.flatnonzero(asked), np.flatnonzero(~asked)
    some = some[np.lexsort((x[some], y[some]))]
    squared = np.full(len(some), np.inf)
    if len(some) and len(marks):
        rows, row = np.unique(y[some], return_inverse=True)
        sites, j = np.unique(x[marks], return_inverse=True)
        above, below = np.full((len(rows), len(sites)), -np.inf), np.full((len(rows), len(sites)), np.inf)
        for mark, column in ((y[marks], j), (table.column("next").to_numpy()[marks], j)):
            known = ~np.isnan(mark)
            mark, column = mark[known], column[known]
            at = np.searchsorted(rows, mark, "right") - 1  # last row at or above the mark's place
            near = at >= 0
            after = np.searchsorted(rows, mark, "left")
            np.maximum.at(above, (np.minimum(after, len(rows) - 1)[after < len(rows)], column[after < len(rows)]), mark[after < len(rows)])
            np.minimum.at(below, (at[near], column[near]), mark[near])
        np.maximum.accumulate(above, axis=0, out=above)
        below = np.minimum.accumulate(below[::-1], axis=0)[::-1]
        line = rows[:, None].astype(float)
        heights = (np.minimum(line - above, below - line) * spacing[0]) ** 2
        squared = least_parabola(heights, sites, row, x[some], spacing[1])
    kept = table.select(["image", "y", "x", *others]).take(pa.array(some))
    return kept.append_column("distance", pa.array(np.sqrt(squared)))


def nearest(cells: DataFrame, marks: DataFrame, spacing: tuple[float, float] = (1.0, 1.0), others: tuple[str, ...] = (), strip: int = STRIP) -> DataFrame:
    """``cells`` (``image, y, x`` and some string columns) with the ``distance`` to the nearest of ``marks`` (``image, y, x``)
    of their image, infinite without any. Rows may repeat on both sides."""
    keys = [F.col("image").cast("long").alias("image"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")]
    cells, marks = cells.select(*keys, *others), marks.select(*keys).distinct()
    ends = cells.select("image", "y", "x").unionByName(marks).groupBy("image").agg(F.max("y").alias("last"), F.max("x").alias("wide"))
    ends = ends.select("image", "last", F.greatest(F.lit(1), F.floor(F.lit(strip) / (F.col("wide") + 1)).cast("int")).alias("rows"))
    ends = ends.hint("broadcast")  # a row for each image: else Spark takes the cells, whose file is far smaller than they are
    column = Window.partitionBy("image", "x").orderBy("y")
    marks = marks.withColumns({"next": F.lead("y").over(column), "before": F.lag("y").over(column)}).join(ends, "image")
    first, last = F.when(F.col("before").isNull(), 0).otherwise(F.col("y")), F.coalesce(F.col("next") - 1, "last")
    strips = F.sequence(F.floor(first / F.col("rows")).cast("int"), F.floor(F.greatest(first, last) / F.col("rows")).cast("int"))
    marks = marks.select("image", F.explode(strips).alias("strip"), "y", "x", F.col("next").cast("double").alias("next"), F.lit(False).alias("asked"), *[F.lit(None).cast("string").alias(c) for c in others])
    asked = cells.join(ends, "image").select("image", F.floor(F.col("y") / F.col("rows")).cast("int").alias("strip"), "y", "x", F.lit(None).cast("double").alias("next"), F.lit(True).alias("asked"), *[F.col(c).cast("string").alias(c) for c in others])
    schema = "image long, y int, x int, " + "".join(f"{c} string, " for c in others) + "distance double"
    names = list(others)
    return marks.unionByName(asked).groupBy("image", "strip").applyInArrow(lambda table: _strip(table, spacing, names), schema)
