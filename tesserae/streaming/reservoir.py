"""The priority reservoir over a stream of record batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.splits import reservoir


def streaming_reservoir(stream: DataFrame, path: str, capacity: int, key: str, seed: int, **options: str):
    """Keeps the ``capacity`` records with the smallest keys seen so far, in Parquet below ``path`` by batch.

    Each batch merges with the table that the one before it left, so that a batch run again gives the same table.
    Returns the running query; ``latest`` reads its result.
    """
    return stream.writeStream.foreachBatch(_merge(path, capacity, key, seed)).options(**options).start()


def _merge(path: str, capacity: int, key: str, seed: int) -> Callable[[DataFrame, int], None]:
    from pyspark.sql import functions as F

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch
        if number:
            rows = rows.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/{number - 1}"))
        reservoir(rows, capacity, seed, F.col(key)).drop("order_key").write.mode("overwrite").parquet(f"{path}/{number}")

    return merge


def latest(spark, path: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{path}/{number}")
