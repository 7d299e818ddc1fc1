"""Everything that is known of a prediction on an image, as one nested row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rates import pixel_metrics, ratio
from . import confusion, contours, matching


def evaluate(plane: DataFrame, target: str, prediction: str, valid: str, tolerance: float = 2.0, overlap: float = 0.1, least: int = 1, connectivity: int = 8, pixel_area: float = 1.0, spacing: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """``image`` and the structs ``pixel, boundary, centerline, instance, burden`` of sized images with three masks."""
    t, p, v = F.col(target), F.col(prediction), F.col(valid)
    counts = confusion.confusion(plane, ["image"], t, p, v)
    tp, fp, fn, tn = (F.col(x) for x in confusion.COUNTS)
    metrics = pixel_metrics(tp, fp, fn, tn)
    true, called, n = tp + fn, tp + fp, tp + fp + fn + tn
    burden = {
        "true_fraction": ratio(true, n, None), "predicted_fraction": ratio(called, n, None), "absolute_error": F.abs(ratio(called - true, n, None)),
        "true_area": true * pixel_area, "predicted_area": called * pixel_area, "absolute_area_error": F.abs(called - true) * pixel_area,
    }
    named = lambda columns: F.struct(*[x.alias(k) for k, x in columns.items()])
    base = counts.select("image", named({"tp": tp, "fp": fp, "fn": fn, "tn": tn} | metrics).alias("pixel"), named(burden).alias("burden"))
    cells = lambda m: plane.where(m & v).select("image", "y", "x")
    sides = [matching.instances(cells(m), least, connectivity) for m in (t, p)]
    blocks = {
        "boundary": contours.boundary_metrics(plane, target, prediction, valid, tolerance, spacing),
        "centerline": contours.centerline_metrics(plane, target, prediction, valid, tolerance, spacing),
        "instance": matching.instance_counts(plane, *sides, overlap),
    }
    for name, block in blocks.items():
        base = base.join(block.select("image", F.struct(*[c for c in block.columns if c != "image"]).alias(name)), "image")
    return base.select("image", "pixel", "boundary", "centerline", "instance", "burden")
