"""Tokenised output in bit-plane files.

A file holds the ids of whole documents, in ascending doc_id order, cut into fixed-size blocks. Each block is
transposed into byte planes (or bit planes), so that equal places stand together, and each plane is compressed with
zstandard. An index of the planes' places, and the documents' ids and lengths, follow; a footer tells where.

    magic | planes of block 0 | planes of block 1 | ... | documents | index | footer

Files are rows of a table in Spark's own storage, whose committer takes care of failed and repeated tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .word_ids import word_ids

MAGIC = b"TSRPLN01"
FOOTER = struct.Struct("<QQIIIB8s")  # places of documents and index; documents, blocks, block size; bits a plane; magic


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """Planes of ``bits`` (1 or 8) bits of unsigned 32-bit ids, lowest first."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(4)]
    planes = np.unpackbits(rows, axis=1, bitorder="little").T
    return [x.tobytes() for x in np.packbits(planes, axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    if bits == 8:
        return np.stack([np.frombuffer(x, np.uint8, n) for x in planes], axis=1).copy().view("<u4").ravel()
    rows = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")[:n] for x in planes], axis=1)
    return np.packbits(rows, axis=1, bitorder="little").view("<u4").ravel()


def encode_file(doc_ids: list[int | None], ids: list[bytes], block: int, bits: int, level: int = 3) -> bytes:
    """The file of documents with little-endian unsigned 32-bit ``ids``."""
    press = zstandard.ZstdCompressor(level=level).compress
    every = np.frombuffer(b"".join(ids), "<u4")
    out, place, index = [MAGIC], len(MAGIC), []
    for i in range(0, len(every), block):
        for plane in to_planes(every[i : i + block], bits):
            part = press(plane)
            index.append((place, len(part)))
            out.append(part)
            place += len(part)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    docs = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([len(x) // 4 for x in ids], "<u8").tobytes() + known.tobytes()
    out += [docs := press(docs), table := press(np.array(index, "<u8").reshape(-1, 2).tobytes())]
    footer = FOOTER.pack(place, place + len(docs), len(doc_ids), -(-len(every) // block), block, bits, MAGIC)
    return b"".join([*out, struct.pack("<Q", len(table)), footer])


def decode_file(data: bytes) -> tuple[list[int | None], list[bytes]]:
    docs_at, index_at, n, blocks, block, bits, magic = FOOTER.unpack(data[-FOOTER.size :])
    if magic != MAGIC or data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token plane file")
    open_ = zstandard.ZstdDecompressor().decompress
    docs = open_(data[docs_at:index_at])
    doc_ids, lengths, known = np.frombuffer(docs, "<i8", n), np.frombuffer(docs, "<u8", n, 8 * n), np.frombuffer(docs, np.uint8, n, 16 * n)
    index = np.frombuffer(open_(data[index_at : -FOOTER.size - 8]), "<u8").reshape(blocks, 32 // bits, 2)
    total, parts = int(lengths.sum()), []
    for k, places in enumerate(index.tolist()):
        planes = [open_(data[at : at + size]) for at, size in places]
        parts.append(from_planes(planes, min(block, total - k * block), bits))
    ids = memoryview(b"".join(x.tobytes() for x in parts))
    ends = np.cumsum(lengths, dtype=np.int64) * 4
    return [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)], [bytes(ids[e - 4 * int(x) : e]) for e, x in zip(ends.tolist(), lengths, strict=True)]


@dataclass(frozen=True)
class TokenFiles:
    """Files of about ``file_tokens`` ids (whole documents), in blocks of ``block`` ids, planes of ``plane_bits`` bits."""

    tokenizer: str
    end_id: int
    block: int = 1 << 16
    plane_bits: int = 8
    file_tokens: int = 1 << 20

    def write(self, docs: DataFrame, path: str) -> None:
        """Encode ``doc_id, text`` (null: empty; other columns are ignored) to files below ``path``.

        Rows are ordered by doc_id, nulls first, then text. A document of any length stands whole in one file.
        """
        name, end, block, bits, most = self.tokenizer, struct.pack("<I", self.end_id), self.block, self.plane_bits, self.file_tokens
        schema = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, file, start, size = TaskContext.get().partitionId(), 0, 0, 0
            doc_ids, ids = [], []

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_pylist(
                    [{"part": part, "file": file, "start": start, "n_tokens": size, "data": encode_file(doc_ids, ids, block, bits)}], schema
                )

            encoder = word_ids(name)
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    few = batch.slice(i, 256)
                    for doc, x in zip(few.column(0).to_pylist(), encoder.ids(few.column(1).to_pylist()), strict=True):
                        doc_ids.append(doc)
                        ids.append(x + end)
                        size += len(x) // 4 + 1
                        if size >= most:
                            yield flush()
                            file, start, size, doc_ids, ids = file + 1, start + size, 0, [], []
            if doc_ids:
                yield flush()

        rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
        files = rows.mapInArrow(run, "part int, file int, start long, n_tokens long, data binary")
        files.write.option("compression", "uncompressed").parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> DataFrame:
        """``doc_id, start, n_tokens, ids`` of each document; start counts the ids of all documents before it."""
        files = spark.read.parquet(path)
        # a row for each written partition: their number bounds this window and what is broadcast
        parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
        before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
        files = files.join(F.broadcast(parts), "part").select((F.col("before") + F.col("start")).alias("start"), "data")
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    start, data = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                    doc_ids, ids = decode_file(data)
                    counts = np.array([len(x) // 4 for x in ids], np.int64)
                    starts = start + np.cumsum(counts) - counts
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(counts), pa.array(ids, pa.binary())], schema=schema)

        return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
