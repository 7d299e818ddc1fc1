"""From scores of a calibration and a test split to a locked threshold and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rates import pixel_metrics
from ..storage import keep
from . import ranking


def candidate_counts(rows: DataFrame, candidates: list[float]) -> DataFrame:
    """``threshold, tp, fp, fn, tn`` of ``score >= threshold`` for each of some candidates; rows are ``score, target``.

    A row counts once, at the number of candidates that it reaches; sums over these few numbers give all thresholds.
    """
    levels = sorted(set(candidates))
    known = F.array(*[F.lit(float(x)) for x in levels])
    reached = rows.where("score is not null").groupBy(F.size(F.filter(known, lambda c: c <= F.col("score"))).alias("k")).agg(F.count_if("target").alias("p"), F.count_if(~F.col("target")).alias("n"))
    place = rows.sparkSession.createDataFrame([(k + 1, x) for k, x in enumerate(levels)], "k int, threshold double")
    every = place.join(reached, "k", "full")
    one, whole = Window.partitionBy(F.lit(1)), F.lit(0)  # as many rows as candidates
    down = one.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    p, n = F.coalesce("p", whole), F.coalesce("n", whole)
    every = every.select("threshold", F.sum(p).over(down).alias("tp"), F.sum(n).over(down).alias("fp"), F.sum(p).over(one).alias("all_p"), F.sum(n).over(one).alias("all_n"))
    return every.where("threshold is not null").select("threshold", "tp", "fp", (F.col("all_p") - F.col("tp")).alias("fn"), (F.col("all_n") - F.col("fp")).alias("tn"))


def lock(calibration: DataFrame, candidates: int = 65) -> tuple[float, float]:
    """The threshold with the largest (dice, precision, threshold) among quantiles of the calibration's scores at even levels, and
    its dice. The quantiles are as many as asked for, and all that the driver reads. An error without scores."""
    levels = [k / (candidates - 1) for k in range(candidates)]
    grid = [x["value"] for x in ranking.quantiles(calibration.withColumn("one", F.lit(1)), ["one"], "score", levels).select("value").distinct().collect()]
    if not grid:
        raise ValueError("no scores calibrate")
    counts = candidate_counts(calibration, grid)
    found = pixel_metrics(*[F.col(x) for x in ("tp", "fp", "fn", "tn")])
    best = counts.agg(F.max(F.struct(F.round(found["dice"], 12).alias("a"), F.round(found["precision"], 12).alias("b"), "threshold")).alias("best")).first()["best"]
    return best["threshold"], best["a"]


def evaluate(calibration: DataFrame, test: DataFrame, candidates: int = 65) -> DataFrame:
    """One row: the locked ``threshold`` and its calibration dice; counts and metrics of the test rows at it; average precision
    and area under the curve of their scores. Rows are ``score, target``; rows without a score are ``abstained``."""
    threshold, dice = lock(keep(calibration.select("score", "target"), "calibration"), candidates)
    test = keep(test.select("score", "target").withColumn("one", F.lit(1)), "test")
    called = F.col("score") >= threshold
    count = lambda x: F.count_if(x)
    row = test.groupBy("one").agg(
        count(F.col("target") & called).alias("tp"), count(~F.col("target") & called).alias("fp"), count(F.col("target") & ~called).alias("fn"),
        count(~F.col("target") & ~called).alias("tn"), count(F.col("score").isNull()).alias("abstained"),
    )
    found = pixel_metrics(*[F.col(x) for x in ("tp", "fp", "fn", "tn")])
    row = row.select("*", *[found[x].alias(x) for x in ("dice", "precision", "recall")])
    row = row.join(ranking.average_precision(test, ["one"]).select("one", "average_precision"), "one", "left").join(ranking.auroc(test, ["one"]).select("one", "auroc"), "one", "left")
    return row.select(F.lit(threshold).alias("threshold"), F.lit(dice).alias("calibration_dice"), "tp", "fp", "fn", "tn", "abstained", "dice", "precision", "recall", "average_precision", "auroc")
