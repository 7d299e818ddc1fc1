"""Distance from clean references: robust scales, few directions, a shrunk covariance. Vectors are ``id, embedding`` rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranking


@dataclass(frozen=True)
class CleanReference:
    """``center, scale``: of the dimensions; ``directions`` (columns), their ``middle``, and the inverse covariance there."""

    center: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    middle: np.ndarray
    precision: np.ndarray


def _long(rows: DataFrame) -> DataFrame:
    values = rows.select(F.posexplode("embedding").alias("d", "x")).select("d", F.col("x").cast("double").alias("x"))
    return values.where(F.col("x").isNotNull() & ~F.isnan("x"))


def robust_scale(rows: DataFrame) -> DataFrame:
    """``d, center, scale`` of each dimension: the median, and 1.4826 times the median distance to it; where that is zero the
    standard deviation, and where that is zero one. Missing values are left out."""
    values = _long(rows)
    center = ranking.quantile_columns(values, ["d"], "x", center=0.5)
    away = values.join(center, "d").withColumn("away", F.abs(F.col("x") - F.col("center")))
    spread = ranking.quantile_columns(away, ["d"], "away", mad=0.5).join(away.groupBy("d").agg(F.stddev_pop("x").alias("sd")), "d").join(center, "d")
    mad = 1.4826 * F.col("mad")
    return spread.select("d", "center", F.when(mad > 1e-12, mad).when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0).alias("scale"))


def _batches(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return np.array(batch.column(column).to_pylist(), np.float64)


def _projected(rows: DataFrame, model: tuple, clip: float) -> DataFrame:
    """``p``: vectors in units of the scales, clipped, along the directions; missing values stand at the centre."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center, scale, directions = shared.value
        for batch in batches:
            if batch.num_rows:
                z = np.clip(np.nan_to_num((_batches(batch, 0) - center) / scale), -clip, clip) @ directions
                yield pa.RecordBatch.from_arrays([pa.array(list(z), pa.list_(pa.float64()))], ["embedding"])

    return rows.select("embedding").mapInArrow(run, "embedding array<double>")


def _gram(rows: DataFrame, middle: np.ndarray) -> tuple[np.ndarray, int]:
    """Sum of outer products about ``middle`` and the number of vectors: one matrix a task, as large as the dimensions."""
    shared = rows.sparkSession.sparkContext.broadcast(middle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for batch in batches:
            if batch.num_rows:
                z = _batches(batch, 0) - shared.value
                total, n = total + z.T @ z, n + len(z)
        if n:
            place = np.arange(total.size)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel()), pa.array([n] + [0] * (total.size - 1))], ["k", "v", "n"])

    found = rows.mapInArrow(run, "k long, v double, n long").groupBy("k").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("k").toArrow()
    side = len(middle)
    return found.column("v").to_numpy().reshape(side, side), int(found.column("n").to_numpy().sum())


def fit(rows: DataFrame, share: float = 0.98, shrink: float = 0.15, ridge: float = 1e-6) -> CleanReference:
    """Directions that hold ``share`` of the scaled vectors' squares (not centred), and their covariance about the median,
    shrunk to its diagonal. What reaches the driver has the size of the dimensions, squared."""
    scales = robust_scale(rows).orderBy("d").toArrow()
    center, scale = scales.column("center").to_numpy(), scales.column("scale").to_numpy()
    scaled = _projected(rows, (center, scale, np.eye(len(center))), 20.0)
    square, n = _gram(scaled, np.zeros(len(center)))
    if not n:
        raise ValueError("no references to fit")
    values, vectors = np.linalg.eigh(square)
    order = np.argsort(values)[::-1]
    held = np.cumsum(np.maximum(values[order], 0)) / max(np.maximum(values, 0).sum(), 1e-300)
    directions = vectors[:, order[: int(np.searchsorted(held, share)) + 1]]
    low = _projected(rows, (center, scale, directions), 20.0)
    middle = ranking.quantile_columns(_long(low), ["d"], "x", m=0.5).orderBy("d").toArrow().column("m").to_numpy()
    about, n = _gram(low, middle)
    spread = about / max(n - 1, 1)
    spread = (1 - shrink) * spread + shrink * np.diag(np.diag(spread)) + ridge * np.eye(len(middle))
    return CleanReference(center, scale, directions, middle, np.linalg.pinv(spread))


def scores(rows: DataFrame, model: CleanReference) -> DataFrame:
    """``id, score``: the distance of each vector from the references, in their covariance."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                z = np.clip(np.nan_to_num((_batches(batch, 1) - m.center) / m.scale), -50, 50) @ m.directions - m.middle
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", z, m.precision, z), 0)))], ["id", "score"])

    return rows.select(F.col("id").cast("long"), "embedding").mapInArrow(run, "id long, score double")
