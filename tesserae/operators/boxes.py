"""Cells in half-open boxes of any size and place, which come as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(side: Column) -> Column:
    """Least number of bits whose power of two is ``side`` or more."""
    return F.ceil(F.log2(side.cast("double"))).cast("int")


def in_boxes(cells: DataFrame, boxes: DataFrame, out: tuple[str, ...] = ("box",)) -> DataFrame:
    """``cells`` (``image, y, x`` and more) with the columns ``out`` of each box (``image, y0, x0, y1, x1`` and these) that
    holds them: ``y0 <= y < y1`` and ``x0 <= x < x1``.

    A box lies in at most four squares whose side is the power of two that its longer side fits. It goes to these, and a cell
    goes to its square of each size that boxes have, which are as many as the sizes' bits; they meet by an equi-join. Boxes
    without cells inside, nulls included, give no rows; repeated ones count each.
    """
    side = F.greatest(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    squares = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / F.col("size")), F.floor((F.col(high) - 1) / F.col("size"))))
    boxes = boxes.where("y0 < y1 AND x0 < x1").select("image", "y0", "x0", "y1", "x1", F.struct(*out).alias("held"), F.pow(F.lit(2.0), _level(side)).cast("long").alias("size"))
    sizes = sorted(x[0] for x in boxes.select("size").distinct().collect())  # one number for each bit of a size
    boxes = boxes.withColumn("by", squares("y0", "y1")).withColumn("bx", squares("x0", "x1"))
    if not sizes:
        return cells.limit(0).select("*", *[F.lit(None).cast(boxes.schema["held"].dataType[c].dataType).alias(c) for c in out])
    at = cells.select(F.struct(*cells.columns).alias("cell"), F.col("image").alias("own"), F.col("y").alias("cy"), F.col("x").alias("cx"))
    at = at.withColumn("size", F.explode(F.array(*[F.lit(s).cast("long") for s in sizes])))
    at = at.withColumns({"by": F.floor(F.col("cy") / F.col("size")), "bx": F.floor(F.col("cx") / F.col("size"))})
    met = at.join(boxes, (at["own"] == boxes["image"]) & (at["size"] == boxes["size"]) & (at["by"] == boxes["by"]) & (at["bx"] == boxes["bx"]))
    return met.where("cy >= y0 AND cy < y1 AND cx >= x0 AND cx < x1").select("cell.*", "held.*")
