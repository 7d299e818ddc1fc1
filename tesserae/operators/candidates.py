"""Tissue, fold and crack candidates of bright-field images: rows ``image, y, x, r, g, b`` with channels in [0, 1]."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intensity
from ..storage import keep
from . import contours, masks, tiles

_KEYS = ["image", "y", "x"]


def channels(plane: DataFrame) -> DataFrame:
    """Sized images with total optical density ``od``, ``saturation`` and the mean of the channels."""
    rgb = [F.col(c) for c in "rgb"]
    od = reduce(lambda a, b: a + b, map(intensity.optical_density, rgb))
    rows = tiles.sized(plane.select(*_KEYS, *"rgb"))
    return rows.select(*_KEYS, "height", "width", od.alias("od"), intensity.saturation(*rgb).alias("saturation"), ((rgb[0] + rgb[1] + rgb[2]) / 3).alias("light"))


def _marked(rows: DataFrame, cells: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean column: whether the cell is among ``cells``."""
    found = cells.select(*_KEYS).withColumn("found", F.lit(True))
    return tiles.on_cells(rows.drop(name), found, "left").withColumn(name, F.col("found").isNotNull()).drop("found")


def cleaned(rows: DataFrame, mask: str, least: int, closing: float = 0, spacing: tuple[float, float] | None = None) -> DataFrame:
    """``rows`` whose mask is closed by a disk and keeps the 4-connected parts of ``least`` cells or more."""
    if closing > 0:
        closed = tiles.morphology(rows, mask, tiles.disk(closing, spacing), "de")
        rows = tiles.on_cells(rows.drop(mask), closed)
    return _marked(rows, masks.by_area(rows.where(mask), least), mask)


def tissue(rows: DataFrame, least: int = 64, closing: int = 2) -> DataFrame:
    """``rows`` (of ``channels``) with ``support``: what absorbs or has colour, closed, without small parts and holes."""
    seen = ((F.col("od") > 0.12) | (F.col("saturation") > 0.045)) & (F.col("light") < 0.985)
    rows = keep(cleaned(rows.withColumn("support", seen), "support", least, closing), "support")
    return masks.fill_holes(rows, "support", max(4 * least, 64))


def refined(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` whose support also has structure of its own."""
    own = (F.col("od") > 0.18) | (F.col("saturation") > 0.055)
    return cleaned(rows.withColumn("support", F.col("support") & own), "support", max(4, least), 1)


def _tail(rows: DataFrame, limits: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """Percentiles of columns over an image's support, as aggregates."""
    inside = lambda c: F.when(F.col("support"), F.col(c))
    return {f"{c}_{k}": F.percentile(inside(c), F.lit(q / 100)) for c, pair in limits.items() for k, q in zip(("low", "high"), pair, strict=True)}


def _upper(column: str) -> Column:
    return intensity.upper_tail(F.col(column), F.col(f"{column}_low"), F.col(f"{column}_high"))


def fold_scores(rows: DataFrame) -> DataFrame:
    """``rows`` with ``score``: how far density, saturation and texture stand in their upper tails within the support."""
    texture = tiles.local_moments(rows, "od").select(*_KEYS, F.col("sd").alias("texture"))
    rows = keep(tiles.on_cells(rows, texture), "texture")
    limits = _tail(rows, {"od": (65, 98.5), "saturation": (65, 98.5), "texture": (70, 99)})
    rows = rows.join(rows.groupBy("image").agg(*[x.alias(k) for k, x in limits.items()]), "image")
    score = intensity.clip(0.57 * _upper("od") + 0.28 * _upper("saturation") + 0.15 * _upper("texture"))
    return rows.withColumn("score", F.when(F.col("support"), F.coalesce(score, F.lit(0.0))).otherwise(0.0)).drop(*limits)


def folds(rows: DataFrame, least: int = 16, threshold: float = 0.53) -> DataFrame:
    """``rows`` with ``support`` to rows with ``score`` and the mask ``fold``."""
    rows = keep(fold_scores(rows).withColumn("fold", F.col("score") >= threshold), "fold-scores")
    return cleaned(rows, "fold", least, 1).withColumn("fold", F.col("fold") & F.col("support"))


def cracks(rows: DataFrame, least: int = 8, threshold: float = 0.54) -> DataFrame:
    """``rows`` with ``support`` to rows with ``crack_score`` and the mask ``crack``: low signal with tissue around and edges
    near, off the specimen's border, long or branching. The neighbourhood's radius follows the image's size."""
    radius = F.greatest(F.lit(2), F.least(F.lit(5), F.floor(F.least("height", "width") / 64) + 2)).cast("int")
    rows, out = keep(rows.withColumn("radius", radius), "crack-rows"), None
    for x in rows.select("radius").distinct().collect():  # of four radii
        one = _crack_scores(rows.where(F.col("radius") == x["radius"]).drop("radius"), x["radius"])
        out = one if out is None else out.unionByName(one)
    if out is None:
        return rows.drop("radius").select("*", F.lit(0.0).alias("crack_score"), F.lit(False).alias("crack"))
    rows = keep(out.withColumn("crack", F.col("search") & (F.col("crack_score") >= threshold)), "crack-scores")
    rows = _marked(rows, masks.elongated(rows.where("crack"), max(2, least)), "crack")
    return cleaned(keep(rows, "cracks"), "crack", least).drop("search")


def _crack_scores(rows: DataFrame, radius: int) -> DataFrame:
    near = tiles.disk(radius)
    edges = tiles.on_cells(rows.select(*_KEYS, "height", "width"), tiles.gradient(rows, "od"))
    parts = tiles.on_cells(tiles.on_cells(rows, tiles.weighted(rows, "support", near)), tiles.highest(edges, "magnitude", near).withColumnRenamed("high", "edge"))
    closed = tiles.morphology(rows, "support", near, "de").withColumnRenamed("support", "envelope")
    envelope = masks.fill_holes(keep(tiles.on_cells(rows.select(*_KEYS, "height", "width"), closed), "closed"), "envelope")
    envelope = keep(envelope, "envelope")
    parts = tiles.on_cells(tiles.on_cells(parts, envelope.select(*_KEYS, "envelope")), contours.edge_distance(envelope, "envelope"))
    limits = _tail(parts, {"od": (25, 75), "edge": (60, 98)})
    parts = parts.join(parts.groupBy("image").agg(*[x.alias(k) for k, x in limits.items()]), "image")
    low = intensity.lower_signal(F.col("od"), F.col("od_low"), F.col("od_high"))
    gap = (~F.col("support") & F.col("envelope")).cast("double")
    score = 0.47 * low + 0.28 * intensity.clip((F.col("density") - 0.35) / 0.55) + 0.15 * _upper("edge") + 0.10 * gap
    search = F.col("envelope") & (F.col("density") > 0.32) & (F.col("distance") > max(1.0, radius * 0.35))
    parts = parts.withColumn("search", search).withColumn("crack_score", F.when(search, F.coalesce(intensity.clip(score), F.lit(0.0))).otherwise(0.0))
    return parts.drop(*limits, "density", "edge", "envelope", "distance")


def both(plane: DataFrame, least: int = 16) -> DataFrame:
    """Fold and crack masks on a shared support, and the ``review`` mask of all three."""
    rows = keep(refined(keep(tissue(channels(plane), max(4, least), 1), "tissue"), least), "refined")
    rows = cracks(folds(rows, least), max(4, least // 2))
    return rows.withColumn("review", F.col("support") | F.col("fold") | F.col("crack"))
