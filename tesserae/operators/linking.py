"""Connected components of links, by alternating large and small stars, and groups of records that share values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import keep

#: Links that one task may join, 16 bytes each.
FEW = 1 << 17


def _minimum(pairs: DataFrame, name: str) -> DataFrame:
    """Smallest ``v`` of each ``u``; written, so that the join that follows can split a hub's rows."""
    return keep(pairs.groupBy("u").agg(F.min("v").alias("m")), name)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minimum(both, "large").select("u", F.least("u", "m").alias("m"))
    out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return keep(out.where("u <> v").distinct(), "edges")


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have u > v."""
    least = _minimum(edges, "small")
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return keep(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links of a task: the least node of each node's neighbours, then of that node's, until nothing changes."""
    pairs = [np.column_stack([x.to_numpy() for x in batch.columns]) for batch in batches]
    if not pairs:
        return
    node, ends = np.unique(np.concatenate(pairs), return_inverse=True)
    u, v = ends.reshape(-1, 2).T
    label = np.arange(len(node))
    while True:
        low, new = np.minimum(label[u], label[v]), label.copy()
        for side in (u, v, label[u], label[v]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[label])], ["node", "label"])


def components(links: DataFrame, few: int = 0) -> DataFrame:
    """``(u, v)`` long links to ``(node, label)``: every linked node with the smallest node that it reaches.

    Each round writes its links to the shared folder; only a row count and a checksum reach the driver. Up to ``few`` links,
    as counted, are joined in one task, which spares the rounds.
    Nulls and loops are left out; repeated links count once; no links give no rows.
    """
    edges = keep(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    state = _state(edges)
    if 0 < state[0] <= few:
        return edges.select("u", "v").coalesce(1).mapInArrow(_joined, "node long, label long")
    while state[0]:
        edges = _small_star(_large_star(edges))
        before, state = state, _state(edges)
        if state == before:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return nodes.unionByName(roots)


def shared_components(rows: DataFrame, item: str, keys: list[str]) -> DataFrame:
    """``item, component``: the smallest item (a long) that shared values lead to. Nulls link nothing.

    The items of a value are linked to the smallest of them, which takes as many links as there are rows.
    """
    value = F.explode(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(k + "="), F.col(k).cast("string"))) for k in keys]))
    held = keep(rows.select(F.col(item).cast("long").alias("u"), value.alias("value")).where("value is not null and u is not null").distinct(), "held")
    first = keep(held.groupBy("value").agg(F.min("u").alias("v")), "first-of-value")
    label = components(held.join(first, "value").select("u", "v"), FEW)
    items = rows.select(item).distinct()
    out = items.join(label, items[item].cast("long") == label["node"], "left")
    return out.select(item, F.coalesce("label", F.col(item).cast("long")).alias("component"))
