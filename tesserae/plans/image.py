"""Queries of windows, planes, intensities and vectors."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attempts, intensity
from ..operators import anomaly, artifacts, boxes, chain, contours, grid, neighbors, probe, ranking, reservoirs, tiles
from ..sources import arrays
from ..storage import keep, shared_dir
from .views import PLANE, SIZED, VECTORS, plane, table, vectors


def window_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 7).alias("length"))
    return rows.select("p_partkey", F.explode(grid.window_starts(F.col("length"), 64, 48)).alias("start"))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image sizes, from parts."""
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 5).alias("height"), (F.col("p_size") * 3 + 20).alias("width"))


def patch_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.patch_grid(_images(spark, sf_dir), 64, 48)


def halo_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.halo_tiles(_images(spark, sf_dir), 64, 8)


def core_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area that an image's cores cover, against its own: once and whole, or the image is listed."""
    area = F.sum((F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")))
    tiles = grid.halo_tiles(_images(spark, sf_dir), 64, 8).groupBy("p_partkey", "height", "width").agg(area.alias("covered"), F.count("*").alias("tiles"))
    return tiles.select("p_partkey", "tiles", (F.col("covered") == F.col("height") * F.col("width")).alias("exact"))


def level_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pyramid level nearest to a target scale, the first of ties."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 100).alias("target"), F.explode(F.array(*[F.lit(x) for x in range(6)])).alias("level"))
    away = F.round(F.abs(F.ln(F.pow(F.lit(2.0), F.col("level")) / F.col("target"))), 9)
    return rows.groupBy("p_partkey").agg(F.min(F.struct(away.alias("away"), "level")).alias("m")).select("p_partkey", "m.level")


def level_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes to another level: half to even."""
    return table(spark, sf_dir, "part").select("p_partkey", *[F.bround(F.col("p_size") * s).cast("int").alias(n) for n, s in (("y", 0.5), ("x", 2.5))])


def physical_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    um = F.col("p_retailprice") / 100.0
    return table(spark, sf_dir, "part").select("p_partkey", F.rint(um / 0.5).cast("int").alias("pixels"), F.ceil(um / 0.5).cast("int").alias("reach"), F.floor(um / 0.25).cast("int").alias("area"))


def tile_region_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A half-open window of each image."""
    return plane(spark, sf_dir).where("y >= 2 AND y < 42 AND x >= 5 AND x < 37").select("image", "y", "x", "v")


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.in_patches(tiles.sized(plane(spark, sf_dir)), 32, 16)


_PATCH = ["image", "y0", "x0"]


def patch_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments and quantiles of each window."""
    q = lambda p: F.percentile("v", F.lit(p))
    found = {"mean": F.avg("v"), "sd": F.stddev_pop("v"), "p90": q(0.9), "p99": q(0.99)}
    return _patches(spark, sf_dir).groupBy(*_PATCH).agg(F.count("*").alias("n"), *[F.round(x, 6).alias(k) for k, x in found.items()])


def patch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of which a quarter, at least, is tissue."""
    rows = _patches(spark, sf_dir).groupBy(*_PATCH).agg(F.count("*").alias("n"), F.count_if(F.col("event_type").isin("click", "view")).alias("tissue"))
    return rows.where(F.col("tissue") * 4 >= F.col("n"))


def tile_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and largest score of the windows over each cell."""
    scores = _patches(spark, sf_dir).groupBy(*_PATCH).agg(F.round(F.avg("v"), 9).alias("score"))
    # windows are few; each is dealt to the cells that it covers
    rows = tiles.sized(plane(spark, sf_dir)).select("image", "y", "x", "height", "width")
    return grid.in_patches(rows, 32, 16).join(scores, _PATCH).groupBy("image", "y", "x").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.max("score"), 6).alias("high"), F.count("*").alias("windows"))


def box_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells and values in boxes of one to a hundred cells a side, one for each part."""
    key, images = F.col("p_partkey"), plane(spark, sf_dir).agg((F.max("image") + 1).alias("images"))
    size = F.when(key % 97 == 0, 100).otherwise(1 + F.col("p_size") % 20)
    rows = table(spark, sf_dir, "part").crossJoin(images).select(key.alias("box"), (key % F.col("images")).alias("image"), (key * 7 % 90).cast("int").alias("y0"), (key * 13 % 90).cast("int").alias("x0"), size.alias("n"))
    rows = rows.select("box", "image", "y0", "x0", (F.col("y0") + F.col("n")).alias("y1"), (F.col("x0") + F.col("n") * 2).alias("x1"))
    found = boxes.in_boxes(plane(spark, sf_dir).select("image", "y", "x", "v"), rows)
    return found.groupBy("box").agg(F.count("*").alias("cells"), F.round(F.sum("v"), 3).alias("total"))


def array_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes written as array files, and a window of each read back, with the bytes that were read for it."""
    folder = f"{shared_dir(spark)}/tesserae/planes-{uuid.uuid4().hex}"
    keep(arrays.write_planes(plane(spark, sf_dir), folder), "planes")
    rows = arrays.scan_arrays(spark, folder).where("y >= 16 AND y < 40 AND x >= 10 AND x < 30")
    return rows.select(F.regexp_extract("path", r"/(\d+)-\d+\.npy$", 1).cast("long").alias("image"), "y", "x", "v", "bytes")


def token_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of 8 by 8 whose share of marked pixels is 0.2, at least."""
    rows = plane(spark, sf_dir).groupBy("image", F.floor(F.col("y") / 8).cast("int").alias("ty"), F.floor(F.col("x") / 8).cast("int").alias("tx"))
    share = F.avg((F.col("event_type") == "click").cast("double"))
    return rows.agg(F.round(share, 6).alias("share"), (share >= 0.2).alias("label"))


def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean values of 8 by 8 cells, spread over the pixels again."""
    rows = tiles.sized(plane(spark, sf_dir))
    tokens = rows.groupBy("image", F.floor(F.col("y") / 8).cast("int").alias("ty"), F.floor(F.col("x") / 8).cast("int").alias("tx")).agg(F.avg("v").alias("score"))
    return grid.bilinear(tokens, rows).withColumn("v", F.round(F.col("v") + 1e-7, 5))  # no ties


def rolling_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.local_moments(tiles.sized(plane(spark, sf_dir))).withColumns({x: F.round(x, 4) for x in ("mean", "sd")})


def gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.gradient(tiles.sized(plane(spark, sf_dir))).withColumn("magnitude", F.round("magnitude", 5))


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sized images with the masks ``a`` and ``b`` and a valid region."""
    kind = F.col("event_type")
    rows = tiles.sized(plane(spark, sf_dir))
    return rows.select("image", "y", "x", "height", "width", kind.isin("click", "view").alias("a"), kind.isin("view", "click", "purchase").alias("b"), (F.col("v") < 250).alias("valid"))


_MASKS = f"""{SIZED}, masks AS (
    SELECT image, y, x, height, width, event_type IN ('click', 'view') AS a, event_type IN ('view', 'click', 'purchase') AS b, v < 250 AS valid FROM sized)"""


def dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells within a disk of two around clicks."""
    rows = tiles.sized(plane(spark, sf_dir)).withColumn("mask", F.col("event_type") == "click")
    return tiles.morphology(rows, "mask", tiles.disk(2)).where("mask").drop("mask")


def erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose whole disk of one exceeds a value; nothing does outside the image."""
    rows = tiles.sized(plane(spark, sf_dir)).withColumn("mask", F.col("v") > 3)
    return tiles.morphology(rows, "mask", tiles.disk(1), "e").where("mask").drop("mask")


def closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _masks(spark, sf_dir)
    return tiles.morphology(rows, "a", tiles.disk(1), "de").where("a").drop("a")


def boundary_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.boundary(_masks(spark, sf_dir), "a").where("edge").drop("edge")


def boundary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of two masks: shares within two cells, distances both ways."""
    found = contours.boundary_metrics(_masks(spark, sf_dir), "a", "b", "valid", 2.0)
    return found.withColumns({x: F.round(x, 6) for x in ("precision", "recall", "f1", "assd", "hd95")})


def area_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images at three tenths of their height and 40 columns."""
    rows = tiles.sized(plane(spark, sf_dir))
    return grid.area_resample(rows, F.floor(F.col("height") * 3 / 10).cast("int"), 40).withColumn("v", F.round("v", 6))


def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_acctbal").alias("v"))
    return grid.otsu(rows, ["c_mktsegment"], "v").withColumn("threshold", F.round("threshold", 4))


def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_discount").alias("v"))
    return grid.entropy(rows, ["l_suppkey"], F.col("v") * 9.7).withColumn("entropy", F.round("entropy", 6))


def normalize_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("most"), F.avg("l_extendedprice").alias("mean"))
    return rows.select("l_suppkey", F.round(intensity.unit_scale(F.col("mean"), F.col("most")), 6).alias("mean"))


def optical_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_quantity") / 50.0
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(intensity.optical_density(x)), 6).alias("od"), F.round(F.max(intensity.optical_density(x)), 6).alias("most"))


_RGB = {"r": "l_quantity / 50.0", "g": "l_discount * 10", "b": "l_tax * 12.5"}


def stain_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentrations of two stains, grey and saturation, averaged by supplier."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", *[F.expr(v).alias(k) for k, v in _RGB.items()])
    od = [intensity.optical_density(F.col(x)) for x in "rgb"]
    r, g, b = (F.col(x) for x in "rgb")
    first, second = intensity.stain_weights()
    found = {"first": intensity.linear(od, first), "second": intensity.linear(od, second), "gray": intensity.gray(r, g, b), "saturation": intensity.saturation(r, g, b)}
    return rows.groupBy("l_suppkey").agg(*[F.round(F.avg(x), 6).alias(k) for k, x in found.items()])


def tissue_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", *[F.expr(v).alias(k) for k, v in _RGB.items()])
    r, g, b = (F.col(x) for x in "rgb")
    grey = intensity.gray(r, g, b)
    tissue = ((intensity.optical_density(grey) > 0.12) | (intensity.saturation(r, g, b) > 0.045)) & (grey < 0.985)
    return rows.groupBy("l_suppkey").agg(F.count_if(tissue).alias("tissue"), F.count("*").alias("n"))


def tail_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper tail scores and low signal of balances, within segments."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("v"))
    rows = rows.join(ranking.quantile_columns(rows, ["c_mktsegment"], "v", q10=0.1, q25=0.25, q75=0.75, q90=0.9), "c_mktsegment")
    upper, low = intensity.upper_tail(F.col("v"), F.col("q10"), F.col("q90")), intensity.lower_signal(F.col("v"), F.col("q25"), F.col("q75"))
    return rows.select("c_custkey", F.round(upper, 6).alias("upper"), F.round(low, 6).alias("low"))


def normalized_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(intensity.normal_score(F.col("p_retailprice"), 1500.0), 6).alias("score"))


def fuse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice") / 2000.0)
    b = F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") / 50.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(intensity.fuse(a, b, 0.7, 0.3), 6).alias("score"))


def hybrid_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.col("p_partkey") % 9 != 0
    alert = (F.col("p_retailprice") >= 1500) | (both & (F.col("p_size") >= 40))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(alert).alias("alerts"), F.count("*").alias("n"))


def inject_perturb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold and a crack along a curve at several severities, and the cells that each changes."""
    found = artifacts.inject(tiles.sized(plane(spark, sf_dir)), "v", [0.25, 0.5, 1.0])
    changed = F.abs(F.col("new") - F.col("v")) > 1e-9
    return found.groupBy("image", "artifact", "severity").agg(F.count_if(changed).alias("changed"), F.round(F.avg("new"), 6).alias("mean"))


def incremental_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.greatest(F.col("l_discount") - F.col("l_tax"), F.lit(0.0))), 4).alias("gain"))
    return rows


def flip_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute difference of each image and its mirror, and overlap of their alerts."""
    rows = tiles.sized(plane(spark, sf_dir))
    a = rows.select("image", "y", "x", "v")
    b = rows.select("image", "y", (F.col("width") - 1 - F.col("x")).alias("x"), F.col("v").alias("w"))
    hit = lambda c: F.col(c) > 30
    both, each = F.count_if(hit("v") & hit("w")), F.count_if(hit("v")) + F.count_if(hit("w"))
    return a.join(b, ["image", "y", "x"]).groupBy("image", "y").agg(F.round(F.avg(F.abs(F.col("v") - F.col("w"))), 6).alias("mae"), F.round(F.when(each == 0, 1.0).otherwise(2.0 * both / F.when(each > 0, each)), 6).alias("dice"))


def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre and spread of each dimension: median, and the scaled median of the distances to it."""
    found = anomaly.robust_scale(vectors(spark, sf_dir).where("role = 'fit'"))
    return found.select("d", F.round("center", 6).alias("center"), F.round("scale", 6).alias("spread"))


def anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of test vectors from clean references, with the whole covariance."""
    rows = vectors(spark, sf_dir)
    model = anomaly.fit(rows.where("role = 'fit' AND label <= 6"))
    return anomaly.scores(rows.where("role = 'test'"), model).withColumn("score", F.round("score", 4))


def _fit_pass(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Of the vectors to fit: a bank of clean ones, and as many negative as positive ones, from one pass."""
    clean, positive = F.col("label") <= 6, F.col("label") >= 5
    kinds = [reservoirs.Reservoir("bank", clean, 200, 18), reservoirs.Reservoir("negative", ~positive, 60, 24), reservoirs.Reservoir("positive", positive, 60, 30)]
    return reservoirs.gather(vectors(spark, sf_dir).where("role = 'fit'"), kinds)


def fit_reservoirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each reservoir of the fit pass has seen and holds."""
    kept, seen = _fit_pass(spark, sf_dir)
    held = kept.groupBy("name").agg(F.sum("id").alias("ids"), F.max("order_key").alias("last_key"))
    return seen.join(held, "name", "left").select("name", "seen", "stored", "ids", "last_key")


def knn_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test vectors held against the bank of the fit pass, and against the clean calibration's scores."""
    rows = vectors(spark, sf_dir)
    bank = _fit_pass(spark, sf_dir)[0].where("name = 'bank'")
    found = neighbors.calibrated_knn(rows.where("role = 'test'"), bank, rows.where("role = 'calibration' AND label <= 6"), 5, splits=("fit", "calibration"))
    return found.select("id", F.round("score", 5).alias("score"), F.round("percentile", 6).alias("percentile"), "flagged")


def probe_from_fit_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances by a probe that the reservoirs of the fit pass taught."""
    kept = _fit_pass(spark, sf_dir)[0].where("name <> 'bank'").withColumn("positive", F.col("name") == "positive")
    found = probe.scores(vectors(spark, sf_dir).where("role = 'test'"), probe.fit(kept, "positive"))
    return found.withColumn("score", F.round("score", 4))


def linear_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a class-balanced logistic probe, fitted on vectors of two kinds."""
    rows = vectors(spark, sf_dir).withColumn("positive", F.col("label") >= 5)
    model = probe.fit(rows.where("role = 'fit'"), "positive")
    return probe.scores(rows.where("role = 'test'"), model).withColumn("score", F.round("score", 4))


def _chain(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Lock on the calibration, evaluate on the test vectors; marked are those that are not clean."""
    scored = keep(rows.where("role <> 'fit'").select("id", "role", (F.col("label") > 6).alias("target")).join(scores, "id", "left"), "chain")
    found = chain.evaluate(scored.where("role = 'calibration'"), scored.where("role = 'test'"), 33)
    rounded = ("calibration_dice", "dice", "precision", "recall", "average_precision", "auroc")
    return found.withColumns({"threshold": F.round("threshold", 5)} | {x: F.round(F.col(x) + 1e-9, 6) for x in rounded})


def chain_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit pass, bank, neighbours, candidates, locked threshold and evaluation, from one table to one row."""
    rows = vectors(spark, sf_dir)
    scores = neighbors.knn_scores(rows.where("role <> 'fit'"), _fit_pass(spark, sf_dir)[0].where("name = 'bank'"), 5)
    return _chain(rows, scores.withColumn("score", F.round("score", 9)))


def chain_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a probe that the fit pass's reservoirs taught."""
    rows = vectors(spark, sf_dir)
    kept = _fit_pass(spark, sf_dir)[0].where("name <> 'bank'").withColumn("positive", F.col("name") == "positive")
    return _chain(rows, probe.scores(rows.where("role <> 'fit'"), probe.fit(kept, "positive")))


def failed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest reading of each vector, by a scorer that refuses a batch with a broken one: only the broken ones fail."""
    found = vectors(spark, sf_dir).select("id", attempts.attempt(_largest, "embedding").alias("a"))
    return found.select("id", F.round("a.score", 5).alias("score"), "a.status", "a.reason")


def _largest(matrix: np.ndarray) -> np.ndarray:
    if np.abs(matrix).max() > 2.5:
        raise ValueError("a broken reading")
    return matrix.max(axis=1)


def mahalanobis_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    found = neighbors.diagonal_mahalanobis(rows.where("role = 'test'"), rows.where("role = 'fit' AND label <= 6"))
    return found.withColumn("score", F.round("score", 5))


def frozen_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean references fitted, a threshold at the 95th percentile of calibration scores, locked, and the outcome of all other
    vectors by kind; vectors that cannot be scored stay, as abstentions."""
    rows = vectors(spark, sf_dir)
    usable = F.exists("embedding", lambda x: F.abs(x) > 3.5)  # a broken reading
    found = rows.withColumn("broken", usable)
    score = lambda some: neighbors.diagonal_mahalanobis(some.where("NOT broken"), found.where("role = 'fit' AND label <= 6 AND NOT broken"))
    calibration = score(found.where("role = 'calibration' AND label <= 6")).withColumn("one", F.lit(1))
    locked = ranking.quantile_columns(calibration, ["one"], "score", threshold=0.95)
    test = found.where("role = 'test'")
    judged = test.select("id", "label", F.lit(1).alias("one")).join(score(test), "id", "left").join(locked, "one", "left")
    outcome = F.when(F.col("score").isNull(), "abstained").when(F.col("score") > F.col("threshold"), "alert").otherwise("clean")
    return judged.groupBy((F.col("label") <= 6).alias("reference"), outcome.alias("outcome")).agg(F.count("*").alias("n"))


def patch_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    found = neighbors.knn_scores(rows.where("role = 'test'"), rows.where("role = 'fit' AND label <= 6"), 5)
    return found.withColumn("score", F.round("score", 5))


def vector_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine and largest difference of each vector and the vector of the next id, as two devices' outputs."""
    rows = vectors(spark, sf_dir)
    other = rows.select((F.col("id") + 1).alias("id"), F.col("embedding").alias("other"))
    rows = rows.join(other, "id")
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(product("embedding", "embedding") * product("other", "other"))
    most = F.array_max(F.zip_with("embedding", "other", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return rows.select("id", F.round(product("embedding", "other") / norm, 5).alias("cosine"), F.round(most, 5).alias("most"))


QUERIES = {
    f.__name__: f
    for f in (
        window_starts, patch_grid, halo_windows, core_stitch, level_choice, level_box, physical_units, tile_region_scan, patch_features, patch_filter,
        tile_stitch, token_labels, heatmap, rolling_std, gradient, dilate, erode, closing, boundary_pixels, boundary_match, area_resample, otsu, entropy,
        normalize_unit, optical_density, stain_linear, tissue_predicate, tail_score, normalized_score, fuse_scores, hybrid_or, inject_perturb,
        incremental_score, flip_consistency, robust_scale, frozen_eval, anomaly_scores, linear_probe, mahalanobis_diag, patch_knn, fit_reservoirs, knn_calibrated, probe_from_fit_pass, chain_knn, chain_probe, failed_scores, box_cells, array_window, vector_agreement,
    )
}

_STARTS = "CASE WHEN {0} <= 64 THEN [0] ELSE list_distinct(list_append(range(0, {0} - 64 + 1, 48), {0} - 64)) END"
_IMAGES = "images AS (SELECT p_partkey, p_size * 5 AS height, p_size * 3 + 20 AS width FROM part)"
_TILES = f"""{_IMAGES}, ys AS (SELECT *, unnest(range(0, height, 64)) AS y0 FROM images), xs AS (SELECT *, unnest(range(0, width, 64)) AS x0 FROM ys),
    tiles AS (SELECT p_partkey, height, width, y0, x0, least(y0 + 64, height) AS y1, least(x0 + 64, width) AS x1 FROM xs)"""
_COVER = f"""{SIZED}, covered AS (
    SELECT s.*, y0, x0 FROM sized s,
        (SELECT DISTINCT image AS i, unnest(CASE WHEN height <= 32 THEN [0] ELSE list_distinct(list_append(range(0, height - 31, 16), height - 32)) END)::INT AS y0 FROM sized) a,
        (SELECT DISTINCT image AS j, unnest(CASE WHEN width <= 32 THEN [0] ELSE list_distinct(list_append(range(0, width - 31, 16), width - 32)) END)::INT AS x0 FROM sized) b
    WHERE i = image AND j = image AND y >= y0 AND y < y0 + 32 AND x >= x0 AND x < x0 + 32)"""
_OD = "-ln(least(greatest({}, 0.5/65535), 1.0))"
_RGB_SQL = "rgb AS (SELECT l_suppkey, l_quantity / 50.0::DOUBLE AS r, l_discount * 10 AS g, l_tax * 12.5::DOUBLE AS b FROM lineitem)"
_GRAY, _SAT = "(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b)", "((greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b, 1e-6))"
_MIRROR = "CASE WHEN {0} < 0 THEN -1 - ({0}) WHEN {0} >= {1} THEN 2 * {1} - 1 - ({0}) ELSE {0} END"


def _around(reach: int) -> str:
    """Each cell with the cells of the square around it, of a mirrored image."""
    y, x = _MIRROR.format("a.y + dy", "a.height"), _MIRROR.format("a.x + dx", "a.width")
    return f"FROM sized a, range(-{reach}, {reach + 1}) AS r(dy), range(-{reach}, {reach + 1}) AS q(dx), sized b WHERE b.image = a.image AND b.y = {y} AND b.x = {x}"


def disk_sql(radius: int) -> str:
    """Offsets of a disk."""
    return f"(SELECT dy::INT AS dy, dx::INT AS dx FROM range(-{radius}, {radius + 1}) AS r(dy), range(-{radius}, {radius + 1}) AS q(dx) WHERE dy * dy + dx * dx <= {radius * radius})"


def _edge(name: str, mask: str) -> str:
    """Boundary cells: of nine cells around, not all belong to the mask; but next to an invalid one."""
    return f"""{name} AS (
        SELECT a.image, a.y, a.x FROM masks a JOIN masks c ON c.image = a.image AND abs(c.y - a.y) <= 1 AND abs(c.x - a.x) <= 1
        WHERE a.{mask} AND a.valid GROUP BY a.image, a.y, a.x HAVING count(*) FILTER (c.{mask} AND c.valid) < 9 AND bool_and(c.valid))"""


_RESERVOIRS = """k AS (SELECT * FROM (VALUES ('bank', 200, 18), ('negative', 60, 24), ('positive', 60, 30)) AS t(name, capacity, seed)),
        r AS (SELECT name, capacity, id, sha256(seed || '|' || id) AS order_key FROM vectors, k WHERE role = 'fit' AND CASE name WHEN 'bank' THEN label <= 6 WHEN 'negative' THEN label < 5 ELSE label >= 5 END),
        held AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY name ORDER BY order_key, id) <= capacity)"""

SQL = {
    "window_starts": f"SELECT p_partkey, unnest({_STARTS.format('(p_size * 7)')})::INT AS start FROM part",
    "patch_grid": f"""WITH {_IMAGES}, ys AS (SELECT *, unnest({_STARTS.format("height")}) AS y0 FROM images), xs AS (SELECT *, unnest({_STARTS.format("width")}) AS x0 FROM ys)
        SELECT p_partkey, height, width, y0::INT AS y0, x0::INT AS x0, least(y0 + 64, height)::INT AS y1, least(x0 + 64, width)::INT AS x1 FROM xs""",
    "halo_windows": f"""WITH {_TILES} SELECT p_partkey, height, width, y0::INT AS y0, x0::INT AS x0, y1::INT AS y1, x1::INT AS x1, greatest(y0 - 8, 0)::INT AS hy0, greatest(x0 - 8, 0)::INT AS hx0,
        least(y1 + 8, height)::INT AS hy1, least(x1 + 8, width)::INT AS hx1 FROM tiles""",
    "core_stitch": "SELECT p_partkey, (ceil(p_size * 5 / 64.0) * ceil((p_size * 3 + 20) / 64.0))::BIGINT AS tiles, true AS exact FROM part",
    "level_choice": """WITH l AS (SELECT p_partkey, level, round(abs(ln(pow(2.0, level) / (p_retailprice / 100))), 9) AS away FROM part, range(6) AS r(level))
        SELECT p_partkey, level::INT AS level FROM l QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY away, level) = 1""",
    "level_box": "SELECT p_partkey, round_even(p_size * 0.5::DOUBLE, 0)::INT AS y, round_even(p_size * 2.5::DOUBLE, 0)::INT AS x FROM part",
    "physical_units": """SELECT p_partkey, round_even(p_retailprice / 100.0::DOUBLE / 0.5::DOUBLE, 0)::INT AS pixels, ceil(p_retailprice / 100.0::DOUBLE / 0.5::DOUBLE)::INT AS reach, floor(p_retailprice / 100.0::DOUBLE / 0.25::DOUBLE)::INT AS area FROM part""",
    "tile_region_scan": f"WITH {PLANE} SELECT image, y, x, v FROM plane WHERE y >= 2 AND y < 42 AND x >= 5 AND x < 37",
    "patch_features": f"WITH {_COVER} SELECT image, y0, x0, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.99), 6) AS p99 FROM covered GROUP BY image, y0, x0",
    "patch_filter": f"WITH {_COVER}, c AS (SELECT image, y0, x0, count(*) AS n, count(*) FILTER (event_type IN ('click', 'view')) AS tissue FROM covered GROUP BY image, y0, x0) SELECT * FROM c WHERE tissue * 4 >= n",
    "tile_stitch": f"""WITH {_COVER}, w AS (SELECT image, y0, x0, round(avg(v), 9) AS score FROM covered GROUP BY image, y0, x0)
        SELECT image, y, x, round(avg(score), 6) AS mean, round(max(score), 6) AS high, count(*) AS windows FROM covered JOIN w USING (image, y0, x0) GROUP BY image, y, x""",
    "token_labels": f"""WITH {PLANE}, t AS (SELECT image, y // 8 AS ty, x // 8 AS tx, avg((event_type = 'click')::INT::DOUBLE) AS share FROM plane GROUP BY ALL) SELECT image, ty, tx, round(share, 6) AS share, share >= 0.2 AS label FROM t""",
    "heatmap": f"""WITH {SIZED}, t AS (SELECT image, y // 8 AS ty, x // 8 AS tx, avg(v) AS score FROM sized GROUP BY ALL), n AS (SELECT image, max(ty) + 1 AS rows, max(tx) + 1 AS cols FROM t GROUP BY image),
        p AS (SELECT s.image, y, x, rows, cols, least(greatest((y + 0.5::DOUBLE) * rows / height - 0.5::DOUBLE, 0), rows - 1)::DOUBLE AS py, least(greatest((x + 0.5::DOUBLE) * cols / width - 0.5::DOUBLE, 0), cols - 1)::DOUBLE AS px FROM sized s JOIN n USING (image))
        SELECT p.image, p.y, p.x, round(sum((1 - abs(py - ty)) * (1 - abs(px - tx)) * score) + 1e-7::DOUBLE, 5) AS v FROM p JOIN t ON t.image = p.image AND abs(py - ty) < 1 AND abs(px - tx) < 1 GROUP BY ALL""",
    "rolling_std": f"WITH {SIZED} SELECT a.image, a.y, a.x, round(avg(b.v), 4) AS mean, round(stddev_pop(b.v), 4) AS sd {_around(2)} GROUP BY ALL",
    "gradient": f"""WITH {SIZED}, g AS (SELECT a.image, a.y, a.x, sum(b.v * dx * CASE WHEN dy = 0 THEN 2 ELSE 1 END) / 8 AS gx, sum(b.v * dy * CASE WHEN dx = 0 THEN 2 ELSE 1 END) / 8 AS gy {_around(1)} GROUP BY ALL)
        SELECT image, y, x, round(sqrt(gx * gx + gy * gy), 5) AS magnitude FROM g""",
    "dilate": f"WITH {SIZED} SELECT DISTINCT b.image, b.y, b.x FROM sized a, {disk_sql(2)} d, sized b WHERE a.event_type = 'click' AND b.image = a.image AND b.y = a.y + dy AND b.x = a.x + dx",
    "erode": f"WITH {SIZED} SELECT a.image, a.y, a.x FROM sized a, {disk_sql(1)} d, sized b WHERE b.image = a.image AND b.y = a.y + dy AND b.x = a.x + dx AND b.v > 3 GROUP BY ALL HAVING count(*) = 5",
    "closing": f"""WITH {_MASKS}, grown AS (SELECT DISTINCT b.image, b.y, b.x FROM masks a, {disk_sql(1)} d, masks b WHERE a.a AND b.image = a.image AND b.y = a.y + dy AND b.x = a.x + dx)
        SELECT a.image, a.y, a.x FROM grown a, {disk_sql(1)} d, grown b WHERE b.image = a.image AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL HAVING count(*) = 5""",
    "boundary_pixels": f"WITH {_MASKS}, {_edge('e', 'a')} SELECT * FROM e",
    "boundary_match": f"""WITH {_MASKS}, {_edge("ea", "a")}, {_edge("eb", "b")},
        d AS (SELECT s.image, 'a' AS side, s.y, s.x, min(sqrt(pow(s.y - o.y, 2) + pow(s.x - o.x, 2))) AS d FROM ea s JOIN eb o ON s.image = o.image GROUP BY ALL
              UNION ALL SELECT s.image, 'b', s.y, s.x, min(sqrt(pow(s.y - o.y, 2) + pow(s.x - o.x, 2))) FROM eb s JOIN ea o ON s.image = o.image GROUP BY ALL),
        m AS (SELECT image, count(*) FILTER (side = 'a') AS n_target, count(*) FILTER (side = 'b') AS n_predicted, count(*) FILTER (side = 'a' AND d <= 2)::DOUBLE / count(*) FILTER (side = 'a') AS r,
                     count(*) FILTER (side = 'b' AND d <= 2)::DOUBLE / count(*) FILTER (side = 'b') AS p, avg(d) AS assd, quantile_cont(d, 0.95) AS hd95 FROM d GROUP BY image)
        SELECT image, n_target, n_predicted, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, round(assd, 6) AS assd, round(hd95, 6) AS hd95 FROM m""",
    "area_resample": f"""WITH {SIZED}, z AS (SELECT *, height * 3 // 10 AS rows, (height * 3 // 10) / height::DOUBLE AS sy, 40 / width::DOUBLE AS sx FROM sized), c AS (
            SELECT image, i::INT AS y, j::INT AS x, v, (least((y + 1) * sy, i + 1) - greatest(y * sy, i)) * (least((x + 1) * sx, j + 1) - greatest(x * sx, j)) AS w
            FROM z, range(30) AS r(i), range(40) AS q(j) WHERE i < rows AND y * sy < i + 1 AND (y + 1) * sy > i AND x * sx < j + 1 AND (x + 1) * sx > j)
        SELECT image, y, x, round(sum(w * v) / sum(w), 6) AS v FROM c GROUP BY image, y, x""",
    "otsu": """WITH e AS (SELECT c_mktsegment AS k, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY k),
        h AS (SELECT k, low, (high - low) / 128 AS step, least(floor((c_acctbal - low) / ((high - low) / 128)), 127) AS bin, count(*) AS n FROM customer JOIN e ON k = c_mktsegment GROUP BY ALL),
        s AS (SELECT *, sum(n) OVER u AS w, sum(n * (low + (bin + 0.5::DOUBLE) * step)) OVER u AS s, sum(n) OVER a AS an, sum(n * (low + (bin + 0.5::DOUBLE) * step)) OVER a AS als FROM h
              WINDOW u AS (PARTITION BY k ORDER BY bin), a AS (PARTITION BY k)),
        b AS (SELECT k, low + (bin + 0.5::DOUBLE) * step AS t, bin, round(w * (an - w) * pow(s / w - (als - s) / (an - w), 2), 6) AS between_ FROM s WHERE bin < 127 AND an > w)
        SELECT k AS c_mktsegment, round(t, 4) AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY between_ DESC, bin) = 1""",
    "entropy": """WITH b AS (SELECT l_suppkey, least(floor(least(greatest(l_discount * 9.7::DOUBLE, 0.0), 1.0) * 32), 31) AS bin, count(*) AS n FROM lineitem GROUP BY ALL),
        p AS (SELECT l_suppkey, n / sum(n) OVER (PARTITION BY l_suppkey)::DOUBLE AS p FROM b) SELECT l_suppkey, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY l_suppkey""",
    "normalize_unit": """WITH m AS (SELECT l_suppkey, max(l_extendedprice) AS most, avg(l_extendedprice) AS mean FROM lineitem GROUP BY l_suppkey)
        SELECT l_suppkey, round(least(greatest(mean / CASE WHEN most <= 1 THEN 1.0 WHEN most <= 255 THEN 255.0 WHEN most <= 65535 THEN 65535.0 ELSE most END, 0.0), 1.0), 6) AS mean FROM m""",
    "optical_density": f"SELECT l_suppkey, round(avg({_OD.format('l_quantity / 50.0::DOUBLE')}), 6) AS od, round(max({_OD.format('l_quantity / 50.0::DOUBLE')}), 6) AS most FROM lineitem GROUP BY l_suppkey",
    "stain_linear": f"""WITH {_RGB_SQL}, o AS (SELECT *, {_OD.format("r")} AS dr, {_OD.format("g")} AS dg, {_OD.format("b")} AS db FROM rgb),
        -- the pseudo-inverse of two stains' densities, by the normal equations: c = (B B')^-1 B od
        n AS (SELECT 0.650*0.650+0.704*0.704+0.286*0.286 AS hh, 0.650*0.072+0.704*0.990+0.286*0.105 AS he, 0.072*0.072+0.990*0.990+0.105*0.105 AS ee),
        p AS (SELECT o.*, n.*, 0.650::DOUBLE * dr + 0.704::DOUBLE * dg + 0.286::DOUBLE * db AS h, 0.072::DOUBLE * dr + 0.990::DOUBLE * dg + 0.105::DOUBLE * db AS e FROM o, n)
        SELECT l_suppkey, round(avg(greatest((ee * h - he * e) / (hh * ee - he * he), 0.0)), 6) AS first, round(avg(greatest((hh * e - he * h) / (hh * ee - he * he), 0.0)), 6) AS second,
               round(avg({_GRAY}), 6) AS gray, round(avg({_SAT}), 6) AS saturation FROM p GROUP BY l_suppkey""",
    "tissue_predicate": f"WITH {_RGB_SQL} SELECT l_suppkey, count(*) FILTER (({_OD.format(_GRAY)} > 0.12 OR {_SAT} > 0.045) AND {_GRAY} < 0.985) AS tissue, count(*) AS n FROM rgb GROUP BY l_suppkey",
    "tail_score": """WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.1) AS q10, quantile_cont(c_acctbal, 0.25) AS q25, quantile_cont(c_acctbal, 0.75) AS q75, quantile_cont(c_acctbal, 0.9) AS q90 FROM customer GROUP BY c_mktsegment)
        SELECT c_custkey, round(least(greatest((c_acctbal - q10) / (q90 - q10), 0.0), 1.0), 6) AS upper, round(least(greatest((q25 - c_acctbal) / greatest(0.75 * q25, q75 - q25, 0.025), 0.0), 1.0), 6) AS low FROM customer JOIN q USING (c_mktsegment)""",
    "normalized_score": "SELECT p_partkey, round(least(greatest(0.5 * p_retailprice / 1500.0, 0.0), 1.0), 6) AS score FROM part",
    "fuse_scores": """WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice / 2000.0 END AS a, CASE WHEN p_partkey % 7 <> 0 THEN p_size / 50.0::DOUBLE END AS b FROM part)
        SELECT p_partkey, round(coalesce((0.7 * a + 0.3 * b) / (0.7::DOUBLE + 0.3::DOUBLE), a, b), 6) AS score FROM s""",
    "hybrid_or": "SELECT p_brand, count(*) FILTER (p_retailprice >= 1500 OR (p_partkey % 9 <> 0 AND p_size >= 40)) AS alerts, count(*) AS n FROM part GROUP BY p_brand",
    "inject_perturb": f"""WITH {SIZED}, s AS (
            SELECT *, abs(y - (height / 2.0::DOUBLE + height / 6.0::DOUBLE * sin(2 * pi() * x / width))) AS away, greatest(1.0, height / 12.0::DOUBLE) AS reach FROM sized),
        sh AS (SELECT s.*, o.v AS shifted FROM s JOIN sized o ON o.image = s.image AND o.y = s.y AND o.x = (s.x - 3 + s.width) % s.width),
        n AS (SELECT image, artifact, severity, v, CASE WHEN away > reach THEN v WHEN artifact = 'fold' THEN v + (0.35::DOUBLE + 0.85::DOUBLE * severity) * shifted ELSE v * 0.30::DOUBLE * (1 - severity) END AS new
              FROM sh, (VALUES ('fold'), ('crack')) AS k(artifact), (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) AS t(severity))
        SELECT image, artifact, severity, count(*) FILTER (abs(new - v) > 1e-9) AS changed, round(avg(new), 6) AS mean FROM n GROUP BY ALL""",
    "incremental_score": "SELECT l_suppkey, round(sum(greatest(l_discount - l_tax, 0.0)), 4) AS gain FROM lineitem GROUP BY l_suppkey",
    "flip_consistency": f"""WITH {SIZED}, j AS (SELECT a.image, a.y, a.v, b.v AS w FROM sized a JOIN sized b ON a.image = b.image AND a.y = b.y AND b.x = a.width - 1 - a.x)
        SELECT image, y, round(avg(abs(v - w)), 6) AS mae, round(CASE WHEN count(*) FILTER (v > 30) + count(*) FILTER (w > 30) = 0 THEN 1.0 ELSE 2.0 * count(*) FILTER (v > 30 AND w > 30) / (count(*) FILTER (v > 30) + count(*) FILTER (w > 30)) END, 6) AS dice FROM j GROUP BY image, y""",
    "robust_scale": f"""WITH {VECTORS}, d AS (SELECT unnest(range(64))::INT AS d, unnest(embedding) AS x FROM vectors WHERE role = 'fit'), c AS (SELECT d, quantile_cont(x, 0.5) AS center FROM d GROUP BY d),
        m AS (SELECT d, any_value(center) AS center, 1.4826::DOUBLE * quantile_cont(abs(x - center), 0.5) AS mad, stddev_pop(x) AS sd FROM d JOIN c USING (d) GROUP BY d)
        SELECT d, round(center, 6) AS center, round(CASE WHEN mad > 1e-12 THEN mad WHEN sd > 1e-12 THEN sd ELSE 1.0 END, 6) AS spread FROM m""",
    "mahalanobis_diag": f"""WITH {VECTORS}, d AS (SELECT id, label, role, unnest(range(64)) AS d, unnest(embedding) AS x FROM vectors), m AS (SELECT d, avg(x) AS mean, stddev_samp(x) AS sd FROM d WHERE role = 'fit' AND label <= 6 GROUP BY d)
        SELECT id, round(sqrt(avg(pow((x - mean) / sd, 2))), 5) AS score FROM d JOIN m USING (d) WHERE role = 'test' AND sd > 0 GROUP BY id""",
    "frozen_eval": f"""WITH {VECTORS}, u AS (SELECT *, list_max(list_transform(embedding, lambda x: abs(x))) > 3.5 AS broken FROM vectors), d AS (SELECT id, label, role, broken, unnest(range(64)) AS d, unnest(embedding) AS x FROM u),
        m AS (SELECT d, avg(x) AS mean, stddev_samp(x) AS sd FROM d WHERE role = 'fit' AND label <= 6 AND NOT broken GROUP BY d),
        s AS (SELECT id, label, role, sqrt(avg(pow((x - mean) / sd, 2))) AS score FROM d JOIN m USING (d) WHERE NOT broken AND sd > 0 GROUP BY ALL), t AS (SELECT quantile_cont(score, 0.95) AS threshold FROM s WHERE role = 'calibration' AND label <= 6)
        SELECT u.label <= 6 AS reference, CASE WHEN score IS NULL THEN 'abstained' WHEN score > threshold THEN 'alert' ELSE 'clean' END AS outcome, count(*) AS n FROM u LEFT JOIN s USING (id), t WHERE u.role = 'test' GROUP BY ALL""",
    "fit_reservoirs": f"""WITH {VECTORS}, {_RESERVOIRS}
        SELECT k.name, (SELECT count(*) FROM r WHERE r.name = k.name) AS seen, (SELECT count(*) FROM held WHERE held.name = k.name) AS stored,
               (SELECT sum(id)::BIGINT FROM held WHERE held.name = k.name) AS ids, (SELECT max(order_key) FROM held WHERE held.name = k.name) AS last_key FROM k""",
    "knn_calibrated": f"""WITH {VECTORS}, {_RESERVOIRS}, u AS (SELECT *, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS e FROM vectors),
        asked AS (SELECT * FROM u WHERE role = 'test' OR (role = 'calibration' AND label <= 6)), bank AS (SELECT u.e FROM held JOIN u USING (id) WHERE name = 'bank'),
        d AS (SELECT asked.id, asked.role, list_distance(asked.e, bank.e) AS d FROM asked, bank),
        n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS k FROM d), s AS (SELECT id, role, round(avg(d), 9) AS score FROM n WHERE k <= 5 GROUP BY ALL),
        c AS (SELECT score FROM s WHERE role = 'calibration')
        SELECT id, round(score, 5) AS score, round((SELECT count(*) FROM c WHERE c.score <= s.score)::DOUBLE / (SELECT count(*) FROM c), 6) AS percentile, score > (SELECT quantile_cont(score, 0.995) FROM c) AS flagged
        FROM s WHERE role = 'test'""",
    "failed_scores": f"""WITH {VECTORS}, a AS (SELECT id, list_max(embedding) AS score, list_max(list_transform(embedding, lambda x: abs(x))) > 2.5 AS broken FROM vectors)
        SELECT id, CASE WHEN NOT broken THEN round(score, 5) END AS score, CASE WHEN broken THEN 'failed' ELSE 'scored' END AS status, CASE WHEN broken THEN 'ValueError: a broken reading' END AS reason FROM a""",
    "box_cells": f"""WITH {PLANE}, n AS (SELECT max(image) + 1 AS images FROM plane), s AS (SELECT p_partkey AS box, p_partkey % images AS image, p_partkey * 7 % 90 AS y0, p_partkey * 13 % 90 AS x0, CASE WHEN p_partkey % 97 = 0 THEN 100 ELSE 1 + p_size % 20 END AS n FROM part, n)
        SELECT box, count(*) AS cells, round(sum(v), 3) AS total FROM s JOIN plane p ON p.image = s.image AND y >= y0 AND y < y0 + n AND x >= x0 AND x < x0 + n * 2 GROUP BY box""",
    "array_window": f"WITH {PLANE} SELECT image, y, x, v, count(*) OVER (PARTITION BY image) * 8 AS bytes FROM plane WHERE y >= 16 AND y < 40 AND x >= 10 AND x < 30",
    "chain_knn": f"""WITH {VECTORS}, {_RESERVOIRS}, u AS (SELECT *, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS e FROM vectors),
        bank AS (SELECT u.e FROM held JOIN u USING (id) WHERE name = 'bank'), d AS (SELECT a.id, a.role, a.label > 6 AS target, list_distance(a.e, bank.e) AS d FROM u a, bank WHERE a.role <> 'fit'),
        n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS k FROM d), s AS (SELECT id, role, target, round(avg(d), 9) AS score FROM n WHERE k <= 5 GROUP BY ALL),
        c AS (SELECT * FROM s WHERE role = 'calibration'), g AS (SELECT DISTINCT unnest(quantile_cont(score, [{", ".join(f"{k / 32}" for k in range(33))}])) AS threshold FROM c),
        m AS (SELECT threshold, count(*) FILTER (target AND score >= threshold) AS tp, count(*) FILTER (NOT target AND score >= threshold) AS fp, count(*) FILTER (target AND score < threshold) AS fn FROM c, g GROUP BY threshold),
        best AS (SELECT threshold, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 12) AS dice, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END, 12) AS precision
                 FROM m ORDER BY dice DESC, precision DESC, threshold DESC LIMIT 1),
        t AS (SELECT * FROM s WHERE role = 'test'), steps AS (SELECT score, count(*) AS n, count(*) FILTER (target) AS p FROM t GROUP BY score),
        up AS (SELECT *, sum(n) OVER o AS cn, sum(p) OVER o AS cp, sum(p) OVER () AS all_p, sum(n) OVER () AS all_n FROM steps WINDOW o AS (ORDER BY score DESC)),
        e AS (SELECT count(*) FILTER (target AND score >= threshold) AS tp, count(*) FILTER (NOT target AND score >= threshold) AS fp, count(*) FILTER (target AND score < threshold) AS fn, count(*) FILTER (NOT target AND score < threshold) AS tn FROM t, best)
        SELECT round(threshold, 5) AS threshold, round(dice + 1e-9, 6) AS calibration_dice, tp, fp, fn, tn, 0::BIGINT AS abstained, round(2.0::DOUBLE * tp / (2 * tp + fp + fn) + 1e-9, 6) AS dice, round(tp::DOUBLE / (tp + fp) + 1e-9, 6) AS precision,
               round(tp::DOUBLE / (tp + fn) + 1e-9, 6) AS recall, round((SELECT sum(p * cp::DOUBLE / cn) / any_value(all_p) FROM up) + 1e-9, 6) AS average_precision,
               round((SELECT sum((n - p) * (cp - p / 2.0::DOUBLE)) / (any_value(all_p)::DOUBLE * (any_value(all_n) - any_value(all_p))) FROM up) + 1e-9, 6) AS auroc FROM e, (SELECT threshold, dice FROM best)""",
    "patch_knn": f"""WITH {VECTORS}, u AS (SELECT *, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding, embedding))) AS e FROM vectors),
        d AS (SELECT a.id, list_distance(a.e, b.e) AS dist FROM u a, u b WHERE a.role = 'test' AND b.role = 'fit' AND b.label <= 6),
        k AS (SELECT id, dist FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist) <= 5) SELECT id, round(avg(dist), 5) AS score FROM k GROUP BY id""",
    "vector_agreement": f"""WITH {VECTORS}, l AS (SELECT x.id, x.embedding AS a, y.embedding AS b FROM vectors x JOIN vectors y ON y.id = x.id - 1)
        SELECT id, round(list_cosine_similarity(a, b), 5) AS cosine, round(list_max(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))), 5) AS most FROM l""",
}
