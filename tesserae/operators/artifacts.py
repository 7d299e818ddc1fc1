"""Folds and cracks put into images, at several severities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inject(plane: DataFrame, value: str, severities: list[float], shift: int = 3) -> DataFrame:
    """``image, y, x, artifact, severity, <value>, new, inside`` of sized images: along a band around a sine curve, a fold adds
    the image shifted sideways (and wrapped), a crack takes most of the signal away."""
    curve = F.col("height") / 2 + F.col("height") / 6 * F.sin(2 * F.pi() * F.col("x") / F.col("width"))
    inside = F.abs(F.col("y") - curve) <= F.greatest(F.lit(1.0), F.col("height") / 12)
    moved = plane.select("image", "y", F.pmod(F.col("x") + shift, F.col("width")).cast("int").alias("x"), F.col(value).alias("shifted"))
    rows = plane.select("image", "y", "x", value, inside.alias("inside")).join(moved, ["image", "y", "x"])
    rows = rows.withColumn("severity", F.explode(F.array(*[F.lit(float(s)) for s in severities]))).withColumn("artifact", F.explode(F.array(F.lit("fold"), F.lit("crack"))))
    fold, crack = F.col(value) + (0.35 + 0.85 * F.col("severity")) * F.col("shifted"), F.col(value) * 0.30 * (1 - F.col("severity"))
    new = F.when(~F.col("inside"), F.col(value)).when(F.col("artifact") == "fold", fold).otherwise(crack)
    return rows.withColumn("new", new)
