"""Rates of confusion counts, intervals and gates, as columns."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, empty: Column | float | None) -> Column:
    """``part / whole`` as a double, ``empty`` where the whole is zero."""
    empty = empty if isinstance(empty, Column) else F.lit(empty).cast("double")
    return F.when(whole == 0, empty).otherwise(part.cast("double") / F.when(whole != 0, whole))


def pixel_metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Metrics of counts. Two empty sides agree (1); an empty prediction of something has precision 0."""
    precision = ratio(tp, tp + fp, F.when(tp + fn == 0, 1.0).otherwise(0.0))
    recall, specificity = ratio(tp, tp + fn, 1.0), ratio(tn, tn + fp, 1.0)
    d = lambda x: x.cast("double")
    root = F.sqrt(d(tp + fp) * d(tp + fn) * d(tn + fp) * d(tn + fn))
    alone = F.when((fp == 0) & (fn == 0), 1.0).otherwise(0.0)
    return {
        "prevalence": ratio(tp + fn, tp + fp + fn + tn, None),
        "precision": precision,
        "recall": recall,
        "specificity": specificity,
        "accuracy": ratio(tp + tn, tp + fp + fn + tn, 1.0),
        "balanced_accuracy": (recall + specificity) / 2,
        "dice": ratio(2 * tp, 2 * tp + fp + fn, 1.0),
        "iou": ratio(tp, tp + fp + fn, 1.0),
        "false_positive_rate": ratio(fp, fp + tn, 0.0),
        "false_negative_rate": ratio(fn, fn + tp, 0.0),
        "mcc": F.when(root == 0, alone).otherwise((d(tp) * d(tn) - d(fp) * d(fn)) / F.when(root != 0, root)),
    }


def wilson(hits: Column, total: Column, confidence: float = 0.95) -> dict[str, Column]:
    """Estimate and bounds of a share; null without a total."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    n = F.when(total > 0, total.cast("double"))
    p = hits / n
    scale = 1 + z * z / n
    center = p + z * z / (2 * n)
    radius = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    lower, upper = (center - radius) / scale, (center + radius) / scale
    return {"estimate": p, "lower": F.when(n.isNotNull(), F.greatest(F.lit(0.0), lower)), "upper": F.when(n.isNotNull(), F.least(F.lit(1.0), upper))}


def gate(value: Column, threshold: float, minimum: bool, evidence: Column, least: int) -> Column:
    """PASS or FAIL of a value against a minimum or maximum; INSUFFICIENT_EVIDENCE with too little of it."""
    good = value >= threshold if minimum else value <= threshold
    return F.when((evidence < least) | value.isNull(), "INSUFFICIENT_EVIDENCE").otherwise(F.when(good, "PASS").otherwise("FAIL"))


def worst(*statuses: Column) -> Column:
    """FAIL before INSUFFICIENT_EVIDENCE before PASS."""
    every = F.array(*statuses)
    found = lambda x: F.array_contains(every, x)
    return F.when(found("FAIL"), "FAIL").when(found("INSUFFICIENT_EVIDENCE"), "INSUFFICIENT_EVIDENCE").otherwise("PASS")


def category(label: Column, prediction: Column) -> Column:
    """TP, FN, FP or TN."""
    return F.when(label, F.when(prediction, "TP").otherwise("FN")).otherwise(F.when(prediction, "FP").otherwise("TN"))
