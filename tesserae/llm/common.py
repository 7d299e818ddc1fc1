"""Table and batch helpers of the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import keep, shared_dir

__all__ = ["hex64", "keep", "shared_dir", "strings", "table", "text_slices", "word_lists"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex64(column) -> F.Column:
    """A signed long as the 16 lower-case hex digits of its 64 bits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def text_slices(texts: list, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters each, one text at least."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size >= limit:
            yield begin, i
            begin, size = i, 0
        size += len(text) if text else 0
    if begin < len(texts):
        yield begin, len(texts)


_ASCII_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_lists(data: bytes, limit: int = 1 << 22) -> Iterator[list[bytes]]:
    """Words of ``data`` between ASCII white space, in lists from about ``limit`` bytes each, so that memory stays bounded."""
    begin = 0
    while len(data) - begin > limit:
        cut = _ASCII_SPACE.search(data, begin + limit)
        if cut is None:
            break
        yield data[begin : cut.start()].split()
        begin = cut.end()
    yield data[begin:].split() if begin else data.split()


def strings(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()
