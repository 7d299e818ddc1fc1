"""Quality by importance resampling.

Two bag-of-n-grams models over hashed buckets, one of target texts and one of all texts, give each text the log ratio
of its probabilities. Gumbel noise turns the ratios into keys whose largest k are a sample without replacement in
proportion to the weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, text_slices

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    """CRC-32 of words, remembered."""

    def __missing__(self, word: str) -> int:
        value = self[word] = zlib.crc32(word.encode())
        return value


def buckets(text: str | None, hashes: _Hashes, size: int) -> np.ndarray:
    """Buckets of the words and word pairs of a text, repeats included."""
    words = _TOKEN.findall(text.lower()) if text else []
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    mixed = np.concatenate((one + np.uint64(1), (one[:-1] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + one[1:]))
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(size)).astype(np.int64)


@dataclass(frozen=True)
class ImportanceResampling:
    """``size`` buckets; weights are of ``window`` n-grams of a text, so that length alone gives none.

    ``labelled``: the target model is learned from so many labelled texts at most, those with the smallest hash of
    their ids, whose ids are broadcast. The model of all texts covers all. ``memo`` words are remembered at a time.
    """

    size: int = 1 << 14
    window: int = 128
    smoothing: float = 1.0
    labelled: int = 100_000
    seed: int = 42
    memo: int = 300_000

    def log_ratios(self, docs: DataFrame, targets: DataFrame) -> np.ndarray:
        """Of each bucket, target against all; ``targets``: ids of target texts."""
        size, memo = self.size, self.memo

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, hashes = np.zeros((2, size), np.int64), _Hashes()
            for batch in batches:
                marks = batch.column(1).to_pylist()
                for text, mark in zip(batch.column(0).to_pylist(), marks, strict=True):
                    n = np.bincount(buckets(text, hashes, size), minlength=size)
                    counts[0] += n
                    if mark:
                        counts[1] += n
                    if len(hashes) > memo:
                        hashes.clear()
            bucket = np.flatnonzero(counts[0])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, *counts[:, bucket])], ["bucket", "every", "target"])

        some = targets.where("doc_id is not null").select("doc_id").distinct()
        some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(self.labelled)
        marked = docs.join(F.broadcast(some.withColumn("mark", F.lit(True))), "doc_id", "left").select("text", "mark")
        total = marked.mapInArrow(run, "bucket long, every long, target long").groupBy("bucket")
        found = total.agg(F.sum("every").alias("every"), F.sum("target").alias("target")).toArrow()
        counts = np.full((2, size), self.smoothing)
        for k, name in enumerate(("every", "target")):
            counts[k, found.column("bucket").to_numpy()] += found.column(name).to_numpy()
        if (counts[1] == self.smoothing).all():  # no targets
            return np.zeros(size)
        chance = counts / counts.sum(axis=1, keepdims=True)
        return np.log(chance[1]) - np.log(chance[0])

    def weights(self, docs: DataFrame, ratios: np.ndarray) -> DataFrame:
        """``doc_id, log_weight`` of each row."""
        shared = docs.sparkSession.sparkContext.broadcast(ratios)
        window, memo = self.window, self.memo

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ratio, hashes = shared.value, _Hashes()
            for batch in batches:
                texts, out = batch.column(1).to_pylist(), []
                for a, b in text_slices(texts):
                    for text in texts[a:b]:
                        found = buckets(text, hashes, len(ratio))
                        out.append(window * float(ratio[found].mean()) if len(found) else 0.0)
                    if len(hashes) > memo:
                        hashes.clear()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "log_weight"])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, log_weight double")

    def sample(self, docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
        """``doc_id, log_weight, sample_key, kept`` of each row of ``docs`` (``doc_id, text``).

        ``labels``: ``doc_id, quality`` rows; those of quality 1 are targets. ``share`` of the rows is kept, by default
        the share of targets among the labels. The noise is a function of the doc_id. A text without words (null,
        empty) has weight 0; equal keys (repeated ids with equal texts) are kept or dropped together; without labels
        all weights are 0 and all rows are kept; other columns are ignored.
        """
        targets = labels.where("quality = 1")
        if share is None:
            share = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
            share = 1.0 if share is None else share
        docs = docs.select(F.col("doc_id").cast("long"), "text")
        scored = self.weights(docs, self.log_ratios(docs, targets.select(F.col("doc_id").cast("long"))))
        unit = (F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        scored = keep(scored.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(unit))), "weights")
        least = kth_largest(scored, "sample_key", lambda n: round(n * share))
        return scored.withColumn("kept", F.lit(False) if least is None else F.col("sample_key") >= least)


def kth_largest(df: DataFrame, column: str, k_of) -> float | None:
    """Exact k-th largest value of a double column without nulls (k from the row count; None if it is 0).

    Histograms of 4096 bins narrow the value down, a pass over the column each; nothing larger reaches the driver.
    """
    low, high, n = df.agg(F.min(column), F.max(column), F.count("*")).first()
    k = k_of(n)
    if not n or k <= 0:
        return None
    k = min(k, n)
    rows, bins = df.select(F.col(column).alias("x")), 4096
    while low < high:
        step = (high - low) / bins
        if step == 0 or low + step == low:
            break
        place = F.least(F.floor((F.col("x") - low) / step), F.lit(bins - 1)).alias("bin")
        found = rows.where(F.col("x").between(low, high)).groupBy(place).agg(F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
        for x in sorted(found.collect(), key=lambda x: -x["bin"]):
            if x["n"] >= k:
                low, high = x["a"], x["b"]
                break
            k -= x["n"]
        if x["n"] == 1:
            break
    return high if k == 1 else low
