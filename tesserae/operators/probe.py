"""A linear probe of vectors: class-balanced logistic regression on standardised dimensions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Probe:
    """``center`` and ``scale`` of each dimension, and the regression on what they standardise."""

    center: list[float]
    scale: list[float]
    model: LogisticRegressionModel

    def standard(self) -> Column:
        return _standard(self.center, self.scale)


def _standard(center: list[float], scale: list[float]) -> Column:
    one = lambda values: F.array(*[F.lit(float(x)) for x in values])
    return array_to_vector(F.zip_with(F.zip_with(F.col("embedding").cast("array<double>"), one(center), lambda x, c: x - c), one(scale), lambda x, s: x / s))


def fit(rows: DataFrame, positive: str, penalty: float = 1e-3, iterations: int = 200) -> Probe:
    """``rows``: ``embedding`` and a boolean column, rows without it left out. Dimensions are scaled by the deviation of the
    vectors as a population; one whose deviation is under 1e-6 says nothing and
    counts as 0 (its weight would be a hundred-thousandth at most). Both classes weigh one half; an error where one
    is missing or the fit does not converge. The optimizer sums gradients over tasks; the driver holds a few numbers for each
    dimension."""
    rows = rows.where(F.col(positive).isNotNull())
    sizes = {x[positive]: x["count"] for x in rows.groupBy(positive).count().collect()}
    if set(sizes) != {True, False}:
        raise ValueError("a probe takes vectors of both classes")
    n = sum(sizes.values())
    found = rows.select(Summarizer.metrics("mean", "variance").summary(array_to_vector(F.col("embedding").cast("array<double>"))).alias("s")).select("s.*").first()
    deviation = [(x * (n - 1) / n) ** 0.5 for x in found["variance"]]
    center, scale = found["mean"].tolist(), [x if x >= 1e-6 else float("inf") for x in deviation]
    weight = F.when(F.col(positive), 0.5 / sizes[True]).otherwise(0.5 / sizes[False]) * n
    data = rows.select(_standard(center, scale).alias("z"), F.col(positive).cast("double").alias("y"), weight.alias("w"))
    logistic = LogisticRegression(featuresCol="z", labelCol="y", weightCol="w", regParam=penalty, standardization=False, maxIter=iterations, tol=1e-10)
    model = logistic.fit(data)
    if model.summary.totalIterations >= iterations:
        raise ValueError("the probe did not converge")
    return Probe(center, scale, model)


def scores(rows: DataFrame, probe: Probe) -> DataFrame:
    """``id, score``: the chance of the positive class."""
    found = probe.model.transform(rows.select("id", probe.standard().alias("z")))
    return found.select("id", F.element_at(vector_to_array("probability"), 2).alias("score"))
