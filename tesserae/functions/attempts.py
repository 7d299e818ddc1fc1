"""Batch functions whose failures are rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def attempted(score: Callable[[np.ndarray], np.ndarray], vectors: list[list[float] | None]) -> list[tuple[float | None, str, str | None]]:
    """``score, status, reason`` of each vector. A batch that raises is halved, down to the rows that raise alone: n rows with
    k failures take about k log n calls. Rows that are null, of another length than the most, or not scored by a finite
    number fail with a reason of their own."""
    out: list[tuple[float | None, str, str | None]] = [(None, "failed", "no vector")] * len(vectors)
    sizes = [len(x) for x in vectors if x is not None]
    usual = max(set(sizes), key=lambda n: (sizes.count(n), n), default=0)
    some = [i for i, x in enumerate(vectors) if x is not None and len(x) == usual]
    for i, x in enumerate(vectors):
        if x is not None and len(x) != usual:
            out[i] = (None, "failed", f"{len(x)} dimensions in place of {usual}")
    todo = [some] if some else []
    while todo:
        part = todo.pop()
        try:
            found = np.asarray(score(np.array([vectors[i] for i in part], np.float64)), np.float64)
            if found.shape != (len(part),):
                raise ValueError(f"{found.shape} scores for {len(part)} rows")
        except Exception as error:  # noqa: BLE001  whatever a scorer raises is the row's reason
            if len(part) == 1:
                out[part[0]] = (None, "failed", f"{type(error).__name__}: {error}")
            else:
                todo += [part[len(part) // 2 :], part[: len(part) // 2]]
            continue
        for i, x in zip(part, found.tolist(), strict=True):
            out[i] = (x, "scored", None) if np.isfinite(x) else (None, "failed", "not a finite score")
    return out


def attempt(score: Callable[[np.ndarray], np.ndarray], vector: str | Column) -> Column:
    """``score double, status string, reason string`` of an array column by a function of a batch's matrix; a failure is a row
    with its reason, and the others keep their scores."""
    kind = pa.struct([("score", pa.float64()), ("status", pa.string()), ("reason", pa.string())])

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found = attempted(score, column.to_pylist())
            yield pa.array([dict(zip(("score", "status", "reason"), x, strict=True)) for x in found], kind)

    return F.arrow_udf(run, "score double, status string, reason string")(vector)
