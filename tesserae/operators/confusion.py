"""Confusion counts and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rates import pixel_metrics, ratio
from .ranking import quantile_columns

COUNTS = ("tp", "fp", "fn", "tn")


def confusion(rows: DataFrame, by: list[str], target: Column, prediction: Column, valid: Column) -> DataFrame:
    """tp, fp, fn, tn and n_valid of the valid rows of each group; groups without valid rows have zeros."""
    cells = {"tp": target & prediction, "fp": ~target & prediction, "fn": target & ~prediction, "tn": ~target & ~prediction}
    return rows.groupBy(*by).agg(*[F.count_if(x & valid).alias(k) for k, x in cells.items()], F.count_if(valid).alias("n_valid"))


def metrics(counts: DataFrame, names: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Adds metrics of the counts."""
    found = pixel_metrics(*[F.col(x) for x in COUNTS])
    return counts.withColumns({k: F.round(found[k], digits) for k in names or found})


def pooled(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.groupBy(*by).agg(*[F.sum(x).alias(x) for x in COUNTS])


def distribution(rows: DataFrame, by: list[str], value: Column, digits: int = 6) -> DataFrame:
    """n, mean, sample deviation, quartiles and their distance."""
    rows = rows.select(*by, value.alias("value"))
    quarters = quantile_columns(rows, by, "value", q1=0.25, median=0.5, q3=0.75).withColumn("iqr", F.col("q3") - F.col("q1"))
    found = rows.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).join(quarters, by, "left")
    return found.select(*by, "n", *[F.round(x, digits).alias(x) for x in ("mean", "sd", "q1", "median", "q3", "iqr")])


def clean_burden(fields: DataFrame, by: list[str]) -> DataFrame:
    """False positives on fields without the artifact (label 0); null where nothing is valid."""
    clean = fields.where("label = 0")
    fraction = ratio(F.col("fp"), F.col("n_valid"), None)
    share = ratio(F.sum("fp"), F.sum("n_valid"), None)
    out = {
        "fp_fraction": share,
        "fp_per_megapixel": ratio(F.sum("fp") * 1_000_000, F.sum("n_valid"), None),
        "alert_rate": F.avg(F.col("image_prediction").cast("double")),
        "mean_area_fraction": F.avg(fraction),
        "share_over_1_percent": F.avg((fraction >= 0.01).cast("double")),
        "share_over_5_percent": F.avg((fraction >= 0.05).cast("double")),
        "pixel_specificity": 1 - share,
    }
    return clean.groupBy(*by).agg(F.count("*").alias("n_clean"), *[F.round(x, 6).alias(k) for k, x in out.items()])


def burden(counts: DataFrame, by: list[str]) -> DataFrame:
    """True and predicted share of valid area, and their signed, absolute and relative error (null where truth is 0 and prediction is not)."""
    n = F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    truth, called = ratio(F.sum(F.col("tp") + F.col("fn")), n, None), ratio(F.sum(F.col("tp") + F.col("fp")), n, None)
    out = counts.groupBy(*by).agg(truth.alias("true_fraction"), called.alias("predicted_fraction"))
    error = F.col("predicted_fraction") - F.col("true_fraction")
    relative = F.when(F.col("true_fraction") != 0, error / F.when(F.col("true_fraction") != 0, F.col("true_fraction"))).when(F.col("predicted_fraction") == 0, 0.0)
    out = out.withColumns({"signed_error": error, "absolute_error": F.abs(error), "relative_error": relative})
    names = [x for x in out.columns if x not in by]
    return out.select(*by, *[F.round(x, 6).alias(x) for x in names])
