"""Several bounded reservoirs of vectors from one pass, with counts of what each has seen."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import keep
from .splits import order_key


@dataclass(frozen=True)
class Reservoir:
    """The ``capacity`` rows of those that ``takes`` (a boolean column) with the smallest hashes of ``seed`` and id."""

    name: str
    takes: Column
    capacity: int
    seed: int


_SCHEMA = "name string, order_key string, id long, embedding array<double>, seen long"


def _smallest(capacity: dict[str, int]):
    """Keeps the smallest keys of each reservoir in a task's rows; a row without an id carries a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {x: [] for x in capacity}
        seen = dict.fromkeys(capacity, 0)
        for batch in batches:
            vectors = batch.column("embedding")
            for i, (name, key, id_, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("name", "order_key", "id", "seen")), strict=True)):
                seen[name] += n
                if id_ is None:
                    continue
                entry = (_Falling((key, id_)), vectors[i])
                if len(held[name]) < capacity[name]:
                    heapq.heappush(held[name], entry)
                elif (key, id_) < held[name][0][0].key:
                    heapq.heapreplace(held[name], entry)
        rows = [(name, *x.key, vector.as_py(), 0) for name, some in held.items() for x, vector in some] + [(name, None, None, None, n) for name, n in seen.items()]
        for a in range(0, len(rows), 4096):
            columns = zip(*rows[a : a + 4096], strict=True)
            kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], ["name", "order_key", "id", "embedding", "seen"])

    return run


class _Falling:
    """Turns the order around, so that a heap has its largest key first."""

    __slots__ = ("key",)

    def __init__(self, key: tuple):
        self.key = key

    def __lt__(self, other: _Falling) -> bool:
        return self.key > other.key


def gather(rows: DataFrame, reservoirs: list[Reservoir], fan_in: int = 8) -> tuple[DataFrame, DataFrame]:
    """``kept``: name, order_key, id, embedding; ``seen``: name, seen, stored. ``rows``: ``id, embedding`` (null ids are left
    out; a null embedding is kept out by ``takes``) and what the reservoirs look at.

    Each task keeps its smallest keys; what tasks kept is merged in a tree, ``fan_in`` at a time, so that no task reads more
    than so many times the capacities. The rows are read once.
    """
    if len({x.name for x in reservoirs}) < len(reservoirs):
        raise ValueError("reservoirs have names of their own")
    taken = F.array_compact(F.array(*[F.when(x.takes, F.struct(F.lit(x.name).alias("name"), order_key(x.seed, F.col("id")).alias("order_key"))) for x in reservoirs]))
    state = rows.where("id is not null").select(F.explode(taken).alias("r"), F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    state = state.select("r.name", "r.order_key", "id", "embedding", F.lit(1).cast("long").alias("seen"))
    run = _smallest({x.name: x.capacity for x in reservoirs})
    state = keep(state.mapInArrow(run, _SCHEMA).withColumn("task", F.spark_partition_id()), "reservoirs")
    tasks = (state.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        tasks = -(-tasks // fan_in)
        merged = state.withColumn("task", F.floor(F.col("task") / fan_in).cast("int")).repartition(tasks, "task").mapInArrow(run, _SCHEMA)
        state = keep(merged.withColumn("task", F.spark_partition_id()), "reservoirs")
    kept = state.where("id is not null").select("name", "order_key", "id", "embedding")
    names = rows.sparkSession.createDataFrame([(x.name,) for x in reservoirs], "name string")
    seen = state.groupBy("name").agg(F.sum("seen").alias("seen"), F.count("id").alias("stored"))
    return kept, names.join(seen, "name", "left").na.fill(0, ["seen", "stored"])
