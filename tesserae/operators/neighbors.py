"""Distances to banks of vectors, and models of clean references."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import keep
from .ranking import percentile_rank, quantile_columns

#: Vectors of a block, of the bank and of the rows.
BLOCK = 8192
#: Distances that a task holds at a time.
CELLS = 1 << 20


def _blocks(rows: DataFrame, size: int, count: int) -> DataFrame:
    """``block, ids, vectors``: rows ``id, embedding`` dealt evenly, by their number, to blocks of ``size`` or so; a block's
    normalised vectors as one matrix."""
    blocks = max(1, -(-count // size))
    numbered = rows.select(F.col("id").cast("long"), "embedding", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int").alias("block"))

    def run(table: pa.Table) -> pa.Table:
        matrix = _unit(np.array(table.column("embedding").to_pylist(), np.float64))
        return pa.table({"block": [table.column("block")[0].as_py()], "ids": [table.column("id").to_pylist()], "vectors": [matrix.tobytes()]}, schema=pa.schema([("block", pa.int32()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary())]))

    return numbered.groupBy("block").applyInArrow(run, "block int, ids array<long>, vectors binary")


def _nearest(rows: np.ndarray, bank: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distances, in any order, of each row to the bank; all of a smaller bank. Vectors are normalised."""
    few, step = min(k, len(bank)), max(1, CELLS // len(bank))
    out = np.empty((len(rows), few))
    for a in range(0, len(rows), step):
        cells = -rows[a : a + step] @ bank.T  # in the order of their distances
        cells.partition(few - 1, axis=1)
        out[a : a + step] = np.sqrt(np.maximum(2 + 2 * cells[:, :few], 0))
    return out


def knn_scores(rows: DataFrame, bank: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``id, score``: mean distance of L2-normalised vectors to the k nearest of ``bank``; rows are ``id, embedding``.

    Blocks of rows meet blocks of the bank by an equi-join and are multiplied in tasks; the k smallest distances to each
    block of the bank are merged. Exact; repeated ids come out repeated; no bank, no rows; nothing passes the driver. A task's
    Python holds a batch of pairs of blocks, which Spark bounds in bytes, and ``CELLS`` distances, whatever the number of rows.
    """
    spark, count = rows.sparkSession, bank.count()
    if not count:
        return spark.createDataFrame([], "id long, score double")
    parts = max(1, -(-count // block))
    copies = max(1, 2 * spark.sparkContext.defaultParallelism // parts)  # of each block of the bank, so that tasks are enough
    own = keep(_blocks(rows, 1024, rows.count()), "row-blocks")
    banked = _blocks(bank.withColumn("id", F.lit(0)), block, count).select(F.col("block").alias("part"), F.col("vectors").alias("bank"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    asked = own.select("block", "ids", "vectors", F.pmod("block", F.lit(copies)).alias("copy"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                number, ids = batch.column(0)[i].as_py(), batch.column(1)[i].values
                mine, bank = (np.frombuffer(batch.column(c)[i].as_buffer()) for c in (2, 3))
                mine = mine.reshape(len(ids), -1)
                near = _nearest(mine, bank.reshape(-1, mine.shape[1]), k)
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(ids)), pa.array(np.arange(len(ids))), ids, pa.array(list(near), pa.list_(pa.float64()))], ["block", "row", "id", "near"])

    met = asked.join(banked, ["part", "copy"]).select("block", "ids", "vectors", "bank")
    found = met.mapInArrow(run, "block long, row long, id long, near array<double>").groupBy("block", "row", "id")
    # as many lists of k as the bank has blocks
    found = found.agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return found.select("id", (F.aggregate("near", F.lit(0.0), lambda a, x: a + x) / F.size("near")).alias("score"))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fingerprint(rows: DataFrame) -> tuple:
    """Number and sums of the vectors' hashes: the same for the same vectors in any order."""
    hashed = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.col("embedding").cast("array<double>")).cast("decimal(38,0)"))
    return tuple(rows.agg(F.count("*"), hashed(0), hashed(1)).first())


def calibrated_knn(rows: DataFrame, bank: DataFrame, calibration: DataFrame, k: int, quantile: float = 0.995, splits: tuple[str, str] | None = None) -> DataFrame:
    """``id, score, percentile, flagged`` of rows (all sides are ``id, embedding``).

    ``percentile``: the share of the clean calibration's scores that are not above the row's; ``flagged``: above their
    ``quantile``. Scores are rounded to nine digits, so that equal vectors have equal ones. Errors: the calibration's vectors
    are the bank's, an id is in both, their ``splits`` have one name, fewer than k vectors in the bank or two to calibrate.
    """
    if splits and splits[0] == splits[1]:
        raise ValueError("fit and calibration are of one split")
    bank, calibration = keep(bank.select("id", "embedding"), "bank"), keep(calibration.select("id", "embedding"), "calibration")
    own, other = fingerprint(bank), fingerprint(calibration)
    if own[0] < k:
        raise ValueError("the bank has fewer vectors than neighbours are asked for")
    if other[0] < 2:
        raise ValueError("two vectors, at least, calibrate")
    if own == other or not bank.join(calibration, "id", "left_semi").isEmpty():
        raise ValueError("the calibration repeats vectors of the bank")
    nine = lambda some: keep(knn_scores(some, bank, k).withColumn("score", F.round("score", 9)), "knn-scores")
    found, clean = nine(rows), nine(calibration)
    limit = quantile_columns(clean.withColumn("one", F.lit(1)), ["one"], "score", threshold=quantile)
    found = found.join(percentile_rank(found, clean), "score").withColumn("one", F.lit(1)).join(limit, "one")
    return found.select("id", "score", "percentile", (F.col("score") > F.col("threshold")).alias("flagged"))


def diagonal_mahalanobis(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """``id, score``: root mean square of the dimensions' deviations from the reference's, in its sample deviations.

    Dimensions in which the reference does not vary are left out. The model is a row for each dimension.
    """
    long = lambda df, *keep: df.select(*keep, F.posexplode("embedding").alias("d", "x"))
    model = long(reference).groupBy("d").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_samp(F.col("x").cast("double")).alias("sd")).where("sd > 0")
    z = (F.col("x").cast("double") - F.col("mean")) / F.col("sd")
    return long(rows, "id").join(model, "d").groupBy("id").agg(F.sqrt(F.avg(z * z)).alias("score"))
