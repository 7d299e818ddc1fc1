"""Array files (.npy, and .npz archives of them) as tables of cells, by a Python data source.

Headers alone are read to plan: a file is cut into bands of rows, filters on ``path``, ``y`` and ``x`` leave bands out and
narrow the others, and a task reads the byte ranges of its band. Paths are of any file system that pyarrow opens.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Members of an archive that are taken without being asked for, the first that there is (fixed values).
PREFERRED = ("image", "data", "arr_0")
SCHEMA = "path string, y int, x int, channel int, v double, bytes_from long, bytes long, issue string"
_KINDS = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.string())
_NAMES = tuple(x.split()[0] for x in SCHEMA.split(", "))


@dataclass(frozen=True)
class Layout:
    """Where an array's values begin, and how they lie. ``member``: of a compressed archive, which is read from its start."""

    offset: int
    dtype: str
    shape: tuple[int, int, int]
    by_column: bool
    member: str | None = None


@dataclass
class Band(InputPartition):
    path: str
    layout: Layout | None
    rows: tuple[int, int] = (0, 0)
    columns: tuple[int, int] = (0, 0)
    issue: str | None = None


def _header(file: io.IOBase | pa.NativeFile) -> tuple[str, tuple[int, int, int], bool]:
    """Type, shape (a plane has one channel) and order of a .npy stream, which is left at the first value."""
    version = np.lib.format.read_magic(file)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
    if read is None:
        raise ValueError(f"version {version} of the format is not known")
    shape, by_column, dtype = read(file)
    if dtype.kind not in "biuf" or len(shape) not in (2, 3) or not all(shape):
        raise ValueError(f"{dtype} values of shape {shape} are no image")
    if by_column and len(shape) == 3:
        raise ValueError("channels in column order are not read")
    return dtype.str, (*shape, 1)[:3], by_column


def chosen(names: list[str], key: str | None) -> str:
    """The member of an archive: ``key``, else the first preferred name, else the only one."""
    have = {x.removesuffix(".npy"): x for x in names if x.endswith(".npy")}
    wanted = key or next((x for x in PREFERRED if x in have), None) or (next(iter(have)) if len(have) == 1 else None)
    if wanted is None or wanted not in have:
        raise ValueError(f"no array {wanted!r} among {sorted(have)}" if wanted else f"several arrays: {sorted(have)}")
    return have[wanted]


def layout(file: pa.NativeFile, path: str, key: str | None) -> Layout:
    """From the header alone."""
    if path.endswith(".npy"):
        if key:
            raise ValueError("only archives have keys")
        dtype, shape, by_column = _header(file)
        return Layout(file.tell(), dtype, shape, by_column)
    with zipfile.ZipFile(file) as archive:
        member = archive.getinfo(chosen(archive.namelist(), key))
        with archive.open(member) as stream:
            dtype, shape, by_column = _header(stream)
            begin = stream.tell()
    if member.compress_type != zipfile.ZIP_STORED:
        return Layout(begin, dtype, shape, by_column, member.filename)
    file.seek(member.header_offset)
    local = file.read(30)
    data = member.header_offset + 30 + int.from_bytes(local[26:28], "little") + int.from_bytes(local[28:30], "little")
    return Layout(data + begin, dtype, shape, by_column)


def read_band(file: pa.NativeFile, band: Band) -> tuple[np.ndarray, int, int]:
    """The values of a band (rows, columns, channels), and the first byte and the number of bytes that were read for them."""
    at, dtype = band.layout, np.dtype(band.layout.dtype)
    height, width, channels = at.shape
    (y0, y1), (x0, x1) = band.rows, band.columns
    outer, inner, long = ((x0, x1), (y0, y1), height) if at.by_column else ((y0, y1), (x0, x1), width)
    step = long * channels * dtype.itemsize  # bytes of a row
    begin, size = at.offset + inner[0] * channels * dtype.itemsize, (inner[1] - inner[0]) * channels * dtype.itemsize
    if at.member is not None:
        with zipfile.ZipFile(file) as archive, archive.open(at.member) as stream:
            stream.seek(at.offset + outer[0] * step)
            data = stream.read((outer[1] - outer[0]) * step)
        first, read = at.offset + outer[0] * step, len(data)
        lines = np.frombuffer(data, dtype).reshape(outer[1] - outer[0], long, channels)[:, inner[0] : inner[1]]
    elif 2 * size >= step:  # most of each row: in one piece
        data = file.read_at((outer[1] - outer[0]) * step, at.offset + outer[0] * step)
        first, read = at.offset + outer[0] * step, len(data)
        lines = np.frombuffer(data, dtype).reshape(outer[1] - outer[0], long, channels)[:, inner[0] : inner[1]]
    else:
        pieces = [file.read_at(size, begin + k * step) for k in range(*outer)]
        first, read = begin + outer[0] * step, size * len(pieces)
        lines = np.frombuffer(b"".join(pieces), dtype).reshape(outer[1] - outer[0], inner[1] - inner[0], channels)
    return (lines.transpose(1, 0, 2) if at.by_column else lines), first, read


def _files(uri: str) -> list[str]:
    system, path = arrow_fs.FileSystem.from_uri(uri)
    info = system.get_file_info(path)
    found = [info] if info.type == arrow_fs.FileType.File else system.get_file_info(arrow_fs.FileSelector(path, recursive=True))
    scheme = uri.split("://")[0] + "://" if "://" in uri else ""
    return sorted(scheme + x.path for x in found if x.type == arrow_fs.FileType.File and x.path.endswith((".npy", ".npz")) and not posixpath.basename(x.path).startswith((".", "_")))


def _open(uri: str) -> pa.NativeFile:
    system, path = arrow_fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.key = options["path"], options.get("key")
        self.cells, self.report = int(options.get("cells", 1 << 20)), options.get("broken", "fail") == "report"
        self.low, self.high, self.paths = {"y": 0, "x": 0}, {"y": 1 << 62, "x": 1 << 62}, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Bounds to prune by; Spark applies all filters again."""
        for f in filters:
            name, value = f.attribute[0] if len(f.attribute) == 1 else None, getattr(f, "value", None)
            if name in self.low and isinstance(value, int):
                if isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan):
                    self.low[name] = max(self.low[name], value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThanOrEqual | LessThan):
                    self.high[name] = min(self.high[name], value + 1 - isinstance(f, LessThan))
            if name == "path" and isinstance(f, EqualTo | In):
                some = set(f.value if isinstance(f, In) else [value])
                self.paths = some if self.paths is None else self.paths & some
            yield f

    def partitions(self) -> list[Band]:
        """A band for each so many cells of each file; the driver reads headers only."""
        out = []
        for path in _files(self.uri):
            if self.paths is not None and path not in self.paths:
                continue
            try:
                with _open(path) as file:
                    found = layout(file, path, self.key)
            except Exception as error:
                if not self.report:
                    raise ValueError(f"{path}: {error}") from error
                out.append(Band(path, None, issue=f"{type(error).__name__}: {error}"))
                continue
            (y0, y1), (x0, x1) = ((self.low[c], min(self.high[c], n)) for c, n in zip("yx", found.shape, strict=False))
            step = max(1, self.cells // (found.shape[1] * found.shape[2]))
            whole = Band(path, found, columns=(x0, x1))
            out += [replace(whole, rows=(a, min(a + step, y1))) for a in range(y0, y1, step) if x0 < x1]
        return out or [Band("", None)]

    def read(self, band: Band) -> Iterator[pa.RecordBatch]:
        if band.layout is None:
            row = (band.path, None, None, None, None, None, None, band.issue)
            if band.issue:
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, _KINDS, strict=True)], list(_NAMES))
            return
        with _open(band.path) as file:
            values, first, read = read_band(file, band)
        (y0, _), (x0, _) = band.rows, band.columns
        per = max(1, (1 << 16) // max(1, values.shape[1] * values.shape[2]))
        for a in range(0, values.shape[0], per):
            part = values[a : a + per].astype(np.float64)
            y, x, c = (z.ravel().astype(np.int32) for z in np.indices(part.shape))
            n = part.size
            columns = ([band.path] * n, y + np.int32(y0 + a), x + np.int32(x0), c, part.ravel(), np.full(n, first), np.full(n, read), [None] * n)
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(columns, _KINDS, strict=True)], list(_NAMES))


class ArrayFiles(DataSource):
    """``spark.read.format("arrays")``: options ``path`` (a file or folder), ``key`` (of archives), ``cells`` of a band, and
    ``broken``: ``fail``, or ``report`` for a row with an ``issue`` in place of each file that cannot be read."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(dict(self.options))


def scan_arrays(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Cells of array files: path, y, x, channel, v; the byte range read for the cell's band; and an issue."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrayFiles)
    return spark.read.format("arrays").option("path", path).options(**options).load()


def write_planes(plane: DataFrame, folder: str, rows: int = 1 << 12) -> DataFrame:
    """Writes ``image, y, x, v`` as .npy files of up to ``rows`` rows, ``<image>-<first row>.npy``; cells that are missing are
    NaN. Gives ``image, first, path``; a task that runs again writes the same file over its old one."""

    def run(table: pa.Table) -> pa.Table:
        image, band = table.column("image")[0].as_py(), table.column("band")[0].as_py()
        y, x = table.column("y").to_numpy() - band * rows, table.column("x").to_numpy()
        dense = np.full((int(y.max()) + 1, int(table.column("width")[0].as_py())), np.nan)
        dense[y, x] = table.column("v").to_numpy()
        path = f"{folder}/{image}-{band * rows}.npy"
        system, place = arrow_fs.FileSystem.from_uri(path)
        system.create_dir(posixpath.dirname(place), recursive=True)
        data = io.BytesIO()
        np.save(data, dense, allow_pickle=False)
        with system.open_output_stream(place) as out:
            out.write(data.getvalue())
        return pa.table({"image": [image], "first": pa.array([band * rows], pa.int32()), "path": [path]})

    width = plane.groupBy("image").agg((F.max("x") + 1).alias("width"))
    cells = plane.join(width, "image").select(F.col("image").cast("long"), F.col("y").cast("int"), F.col("x").cast("int"), F.col("v").cast("double"), "width", F.floor(F.col("y") / rows).cast("int").alias("band"))
    return cells.groupBy("image", "band").applyInArrow(run, "image long, first int, path string")
