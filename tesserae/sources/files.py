"""Readers of manifests, tables and arrays, on Spark's own file access."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.splits import ranked

_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as trimmed strings; a byte-order mark is dropped."""
    rows = spark.read.csv(path, header=True, encoding="utf-8")
    return rows.select(*[F.trim(f"`{x}`").alias(x.strip().removeprefix("﻿")) for x in rows.columns])


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines, blank lines left out; what can't be read stands in ``broken``."""
    return spark.read.schema(f"{schema}, broken string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="broken")


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of one JSON document: a list, or an object whose ``samples`` is one."""
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<struct<{schema}>>")
    held = F.from_json("value", f"samples array<struct<{schema}>>")["samples"]
    return text.select(F.inline(F.when(F.ltrim("value").startswith("["), listed).otherwise(held)))


def manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line, text`` of JSON lines; blank lines count in the numbers. Files are read by blocks, and numbered by spans."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    return ranked(rows, ["path"], "begin", "at").select("path", F.col("place").cast("long").alias("line"), "text")


def manifest_records(spark: SparkSession, path: str) -> DataFrame:
    """``path, line, text, issue`` of JSON documents, a list of records or an object whose ``samples`` is one: a row for each
    record, by its number, or one with an ``issue`` for a document that has none to read. A document is one task."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc"))
    samples = F.try_variant_get("doc", "$.samples", "variant")
    root = F.when(F.schema_of_variant("doc").startswith("ARRAY"), F.col("doc")).otherwise(samples)
    docs = docs.select("path", "doc", F.when(F.schema_of_variant(root).startswith("ARRAY"), root).alias("root"))
    issue = F.when(F.col("doc").isNull(), "json_decode_error").otherwise("invalid_manifest_root")
    broken = docs.where("root is null").select("path", F.lit(1).cast("long").alias("line"), F.lit(None).cast("string").alias("text"), issue.alias("issue"))
    found = spark.sql("SELECT path, CAST(pos + 1 AS BIGINT) AS line, to_json(value) AS text, CAST(NULL AS STRING) AS issue FROM {docs}, LATERAL variant_explode(root)", docs=docs.where("root is not null"))
    return found.unionByName(broken)


def _cell(cell: ElementTree.Element, shared: list[str]) -> str:
    if cell.get("t") == "inlineStr":
        return "".join(x.text or "" for x in cell.iter(f"{_SHEET}t"))
    value = cell.findtext(f"{_SHEET}v") or ""
    return shared[int(value)] if cell.get("t") == "s" and value else value


def _first_sheet(book: zipfile.ZipFile) -> str:
    """The part that holds the workbook's first sheet."""
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(book.namelist()):
        first = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_SHEET}sheets/{_SHEET}sheet")
        parts = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = parts.get(first.get(f"{_LINK}id")) if first is not None else None
        if target:
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return "xl/worksheets/sheet1.xml"


def _letters(place: int) -> str:
    """The name of a column by its number, from 0."""
    name, place = "", place + 1
    while place:
        place, rest = divmod(place - 1, 26)
        name = chr(65 + rest) + name
    return name


def sheet_rows(data: bytes) -> list[dict[str, str]]:
    """Rows of a workbook's first sheet by the names in its first row; blank rows are left out. A cell without a reference
    stands after the one before it."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(x.text or "" for x in item.iter(f"{_SHEET}t")) for item in root.iter(f"{_SHEET}si")]
        sheet = ElementTree.fromstring(book.read(_first_sheet(book)))
    rows = []
    for row in sheet.iter(f"{_SHEET}row"):
        cells, place = {}, -1
        for c in row.iter(f"{_SHEET}c"):
            found = re.match(r"[A-Z]+", c.get("r", ""))
            place = reduce(lambda n, x: n * 26 + ord(x) - 64, found[0], 0) - 1 if found else place + 1
            cells[_letters(place)] = _cell(c, shared).strip()
        if any(cells.values()):
            rows.append(cells)
    head = rows[0] if rows else {}
    return [{name: row.get(column, "") for column, name in head.items()} for row in rows[1:]]


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """``path, row`` (a map of strings) of the first sheets of workbooks; a task reads a workbook."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = sheet_rows(data)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([list(x.items()) for x in rows], kind)], ["path", "row"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, row map<string,string>")


def read_arrays(spark: SparkSession, path: str, tile: int = 256) -> DataFrame:
    """``path, y0, x0, height, width, values`` tiles of two-dimensional .npy files (no pickles), flat and row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plane = np.load(io.BytesIO(data), allow_pickle=False)
                if plane.ndim != 2 or not np.isfinite(plane).all():
                    raise ValueError(f"{name}: not a finite two-dimensional array")
                for y in range(0, plane.shape[0], tile):
                    for x in range(0, plane.shape[1], tile):
                        part = plane[y : y + tile, x : x + tile].astype(np.float64)
                        row = [name, y, x, *part.shape, part.ravel().tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TILE, strict=True)], ["path", "y0", "x0", "height", "width", "values"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, y0 int, x0 int, height int, width int, values array<double>")


_TILE = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()))


def find_files(spark: SparkSession, path: str, *patterns: str) -> DataFrame:
    """``path, length`` of the files below a folder whose names fit a pattern (like ``*.npy``), each once, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(patterns) + "}" if len(patterns) > 1 else patterns[0])
    return files.load(path).select("path", "length").distinct().orderBy("path")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256`` of the bytes of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def read_samples(spark: SparkSession, path: str, modality: str, tile: int = 256) -> DataFrame:
    """Unlabelled samples of .npy files: ``sample_id`` (the file's name without its ending), ``modality`` and the tiles."""
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return read_arrays(spark, path, tile).select(name.alias("sample_id"), F.lit(modality).alias("modality"), "*")


_CHANNEL_METADATA = (
    "ChannelOrder string, Channels array<struct<UID:string>>, ImPixelSize_nm double,"
    " MorphologyKit struct<MorphologyReagents:array<struct<BiologicalTarget:string,Fluorophore:struct<ChannelId:string>>>>"
)


def morphology_channels(metadata: Column, count: Column) -> Column:
    """``names, pixel_size_um`` of a morphology image from its JSON metadata: ``target[uid]`` of each of ``count`` channels.

    Identifiers come from the order's letters, else from the list of channels, else from their numbers; the kit's reagents
    name the targets.
    """
    found = F.from_json(metadata, _CHANNEL_METADATA)
    order = F.coalesce(found["ChannelOrder"], F.lit(""))
    letters = F.when(F.length(order) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(order)), lambda i: F.substr(order, i, F.lit(1))))
    listed = F.transform(F.coalesce(found["Channels"], F.array().cast("array<struct<UID:string>>")), lambda x, i: F.coalesce(x["UID"], i.cast("string")))
    numbered = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.concat(F.lit("channel_"), i.cast("string")))
    uids = F.when(F.size(letters) == count, letters).when(F.size(listed) == count, listed).otherwise(numbered)
    reagents = F.coalesce(found["MorphologyKit"]["MorphologyReagents"], F.array().cast("array<struct<BiologicalTarget:string,Fluorophore:struct<ChannelId:string>>>"))

    def named(uid: Column) -> Column:
        mine = F.filter(reagents, lambda r: r["Fluorophore"]["ChannelId"] == uid)
        return F.concat(F.coalesce(F.get(mine, F.size(mine) - 1)["BiologicalTarget"], uid), F.lit("["), uid, F.lit("]"))

    return F.struct(F.transform(uids, named).alias("names"), (found["ImPixelSize_nm"] / 1000.0).alias("pixel_size_um"))


def cohort_of_name(path: Column) -> Column:
    """The slide in a file's name (``_S12_``), else the name without its ending."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    slide = F.upper(F.regexp_extract(name, r"(?i)_(S\d+)_", 1))
    return F.when(slide != "", slide).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def strict_json(data: bytes) -> dict:
    """A JSON object without repeated members and numbers that are none; anything else is a ``ValueError``."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a member is repeated")
        return dict(pairs)

    def refuse(name: str) -> None:
        raise ValueError(f"{name} is no number")

    found = json.loads(data.decode("utf-8"), object_pairs_hook=once, parse_constant=refuse)
    if not isinstance(found, dict):
        raise ValueError("not an object")
    return found


def read_strict_json(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256, document, error`` of JSON files, one a row: the canonical text, or why there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    text, error = json.dumps(strict_json(data), sort_keys=True, separators=(",", ":")), None
                except ValueError as reason:
                    text, error = None, str(reason)
                row = [name, hashlib.sha256(data).hexdigest(), text, error]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in row], ["path", "sha256", "document", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, sha256 string, document string, error string")


def finite_struct(df: DataFrame) -> DataFrame:
    """Doubles that are no numbers become nulls, in columns and in structs of any depth."""

    def safe(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.DoubleType | T.FloatType):
            return F.when(~F.isnan(column) & (F.abs(column) < float("inf")), column)
        if isinstance(kind, T.StructType):
            return F.when(column.isNotNull(), F.struct(*[safe(column[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType):
            return F.transform(column, lambda x: safe(x, kind.elementType))
        return column

    return df.select(*[safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines with all members; Spark's committer shows them when all are written. No number is NaN or infinite."""
    finite_struct(df).write.option("ignoreNullFields", "false").json(path)


def flattened(df: DataFrame) -> DataFrame:
    """Members of structs as columns with dotted names; arrays as JSON texts."""

    def columns(prefix: str, column: Column, kind: T.DataType) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in columns(f"{prefix}.{f.name}", column[f.name], f.dataType)]
        return [(F.to_json(column) if isinstance(kind, T.ArrayType | T.MapType) else column).alias(prefix)]

    return df.select(*[x for f in df.schema.fields for x in columns(f.name, F.col(f"`{f.name}`"), f.dataType)])


def write_csv(df: DataFrame, path: str) -> None:
    """Rows, flattened, as CSV files with a header."""
    flattened(finite_struct(df)).write.csv(path, header=True)


def markdown_table(df: DataFrame, order: list[str], digits: int = 3, most: int = 10_000) -> str:
    """A report of at most ``most`` rows as a Markdown table; an error if there are more. Nulls are n/a."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has {most} rows at most")
    shown = lambda x: "n/a" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [df.columns, ["---"] * len(df.columns), *[[shown(x) for x in row] for row in rows]]
    return "\n".join(f"| {' | '.join(x)} |" for x in lines)
