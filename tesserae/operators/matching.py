"""Instances of two masks held against each other: overlaps, one-to-one matches, counts at thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import ratio
from ..storage import keep
from . import masks, tiles
from .assignment import assigned, match_changes
from .component_tree import trees
from .ranking import running


def instances(cells: DataFrame, least: int = 1, connectivity: int = 8) -> DataFrame:
    """Labelled cells of the parts of ``least`` cells or more, with the part's ``area``."""
    return masks.by_area(cells, least, None, connectivity)


def overlaps(target: DataFrame, prediction: DataFrame) -> DataFrame:
    """``image, t, p, iou`` of the instances that share cells; both sides are labelled cells with areas."""
    one = lambda rows, k: rows.select("image", "y", "x", F.col("part").alias(k), F.col("area").alias(f"area_{k}"))
    both = tiles.on_cells(one(target, "t"), one(prediction, "p"))
    both = both.groupBy("image", "t", "p").agg(F.count("*").alias("n"), F.first("area_t").alias("a"), F.first("area_p").alias("b"))
    return both.select("image", "t", "p", (F.col("n") / (F.col("a") + F.col("b") - F.col("n"))).alias("iou"))


def matches(target: DataFrame, prediction: DataFrame, threshold: float) -> DataFrame:
    """``image, t, p, iou`` of a one-to-one match of the pairs at ``threshold`` or above: most pairs, then largest overlap.

    Over one half no instance has two such partners, and the pairs are the match; below it they are assigned.
    """
    pairs = overlaps(target, prediction).where(F.col("iou") >= threshold)
    return pairs if threshold > 0.5 else assigned(pairs)


def _side(parts: DataFrame, name: str, by: list[str]) -> DataFrame:
    return parts.groupBy(*by).agg(F.count_distinct("part").alias(name))


def instance_counts(images: DataFrame, target: DataFrame, prediction: DataFrame, threshold: float = 0.1) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 and mean overlap of matched instances, for each of ``images`` (``image``)."""
    found = matches(target, prediction, threshold).groupBy("image").agg(F.count("*").alias("tp"), F.avg("iou").alias("mean_iou"))
    rows = images.select("image").distinct().join(_side(target, "n_true", ["image"]), "image", "left").join(_side(prediction, "n_predicted", ["image"]), "image", "left").join(found, "image", "left")
    rows = rows.withColumns({x: F.coalesce(x, F.lit(0)) for x in ("n_true", "n_predicted", "tp")})
    return rows.select("image", *_measures(F.col("tp"), F.col("n_true"), F.col("n_predicted"), F.col("mean_iou")))


def _measures(tp: Column, true: Column, predicted: Column, overlap: Column) -> list[Column]:
    precision, recall = ratio(tp, predicted, 1.0), ratio(tp, true, 1.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    nothing = F.when((true == 0) & (predicted == 0), 1.0)
    named = {"tp": tp, "fp": predicted - tp, "fn": true - tp, "precision": precision, "recall": recall, "f1": f1, "mean_iou": F.coalesce(overlap, nothing)}
    return [x.alias(k) for k, x in named.items()]


def froc_curve(images: DataFrame, target: DataFrame, scored: DataFrame, overlap: float = 0.1, least: int = 1, connectivity: int = 8) -> DataFrame:
    """tp, fp, fn and sensitivity over all images, and false positives an image, at every distinct score of ``scored`` cells
    (``image, y, x, score``), from one tree of each image: what is called at a threshold are the parts of ``score >= threshold``.

    ``images``: rows whose ``image`` is looked at; images without cells count as images. ``target``: cells ``image, y, x``.
    Parts of fewer than ``least`` cells count on neither side. No scores give no rows.
    """
    total = keep(images.select("image").distinct(), "froc-images")
    parts = keep(instances(target, least, connectivity), "froc-targets")
    changes, pairs = trees(scored, parts, overlap, least, connectivity)
    step = lambda rows, name: rows.select("level", *[(F.col("n") if x == name else F.lit(0)).cast("long").alias(x) for x in ("called", "tp")])
    levels = scored.where("score is not null").select((F.col("score").cast("double") + F.lit(0.0)).alias("level"), F.lit(0).alias("n"))
    rows = step(changes, "called").unionByName(step(match_changes(pairs, overlap), "tp")).unionByName(step(levels, ""))
    steps = running(rows.groupBy("level").agg(*[F.sum(x).alias(x) for x in ("called", "tp")]), [], F.col("level").desc(), ["called", "tp"])
    return _at(steps.select(F.col("level").alias("threshold"), F.col("up_called").alias("called"), F.col("up_tp").alias("tp")), total, parts)


def _at(counts: DataFrame, images: DataFrame, parts: DataFrame) -> DataFrame:
    """``counts``: threshold, called, tp."""
    known = images.agg(F.count("*").alias("n")).crossJoin(parts.agg(F.count_distinct("part").alias("n_true")))  # one row
    tp, fn = F.col("tp"), (F.col("n_true") - F.col("tp")).alias("fn")
    fp = F.col("called") - tp
    return counts.crossJoin(F.broadcast(known)).select("threshold", "tp", fp.alias("fp"), fn, ratio(tp, F.col("n_true"), 1.0).alias("sensitivity"), (fp / F.col("n")).alias("fp_per_image"))


def froc(images: DataFrame, target: DataFrame, scored: DataFrame, thresholds: list[float], overlap: float = 0.1, least: int = 1, connectivity: int = 8) -> DataFrame:
    """The rows of :func:`froc_curve` at given thresholds, which need be no scores, from one tree of each image."""
    total = keep(images.select("image").distinct(), "froc-images")
    parts = keep(instances(target, least, connectivity), "froc-targets")
    changes, pairs = trees(scored, parts, overlap, least, connectivity)
    asked = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    every = changes.select("level", F.col("n").alias("called"), F.lit(0).cast("long").alias("tp"))
    every = every.unionByName(match_changes(pairs, overlap).select("level", F.lit(0).cast("long").alias("called"), F.col("n").alias("tp")))
    every = every.groupBy("level").agg(F.sum("called").alias("called"), F.sum("tp").alias("tp")).select("*", asked)
    above = lambda x: F.coalesce(F.sum(F.when(F.col("level") >= F.col("threshold"), F.col(x))), F.lit(0)).alias(x)
    rows = total.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double").distinct()
    return _at(rows.join(every.groupBy("threshold").agg(above("called"), above("tp")), "threshold", "left").na.fill(0, ["called", "tp"]), total, parts)
