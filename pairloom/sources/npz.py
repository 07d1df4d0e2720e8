"""Featurised .npz archives by ranges of rows: a Spark data source that reads only the bytes of its rows.

An archive is a zip file of arrays whose first axis is the graph. The driver reads the zip directory and the arrays' headers, and plans
ranges of graphs of a bounded number of bytes. A task seeks to its range in each array and reads it in slices, so neither
the driver nor a task ever holds an archive, however large that is. Arrays of a compressed archive can't be entered in the middle:
such an archive is one range, which is decompressed as a stream, slice by slice.

Paths are what the local file system (one that all machines share) or pyarrow's file systems reach: a file, or a folder of `.npz` files.
For other stores there is `datasets.read_npz`, which takes whole files from Spark. Pickled arrays are refused.
"""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .datasets import GRAPH_ROW, Dataset, graph_row, tables_of

#: Bytes of a task's range, and of a slice within it; a graph that is larger is a range by itself.
RANGE_BYTES, SLICE_BYTES = 128 << 20, 8 << 20
#: Arrays of an archive; the last one may be missing.
NEEDED, OPTIONAL = ("V", "A", "labels", "graph_size", "tags"), ("subgraph_size",)
_LOCAL_HEADER = struct.Struct("<4s22xHH")


@dataclass
class Member:
    """Where an array's rows are: kind and shape of a row, number of rows, and the place of the first byte (-1: compressed)."""

    name: str
    dtype: np.dtype
    shape: tuple[int, ...]
    rows: int
    offset: int

    @property
    def row_bytes(self) -> int:
        return self.dtype.itemsize * int(np.prod(self.shape, dtype=np.int64))


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int

    def __init__(self, path: str, start: int, stop: int):
        super().__init__((path, start, stop))
        self.path, self.start, self.stop = path, start, stop


def _opened(path: str):
    """A file that can seek."""
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(inner)


def archives(path: str) -> list[str]:
    """The archives of a path, by name."""
    remote = "://" in path or path.startswith("file:")
    fs, inner = pafs.FileSystem.from_uri(path) if remote else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [path]
    found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(inner)) if f.path.endswith(".npz"))
    prefix = path[: len(path) - len(inner)] if remote and path.endswith(inner) else ""
    return [prefix + f for f in found]


def members(file) -> dict[str, Member]:
    """The arrays of an archive, from its directory and their headers."""
    out = {}
    with zipfile.ZipFile(file) as z:
        for info in z.infolist():
            name = info.filename.removesuffix(".npy")
            if name not in NEEDED + OPTIONAL:
                continue
            with z.open(info) as f:
                version = np.lib.format.read_magic(f)
                shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
                header = f.tell()
            if dtype.hasobject or fortran or not shape:
                raise ValueError(f"array {name} is pickled, not in row order, or has no rows")
            offset = -1
            if info.compress_type == zipfile.ZIP_STORED:
                file.seek(info.header_offset)
                signature, name_length, extra = _LOCAL_HEADER.unpack(file.read(_LOCAL_HEADER.size))
                if signature != b"PK\x03\x04":
                    raise ValueError(f"no entry for {name} where the directory says")
                offset = info.header_offset + _LOCAL_HEADER.size + name_length + extra + header
            out[name] = Member(info.filename, dtype, tuple(shape[1:]), shape[0], offset)
    missing = [n for n in NEEDED if n not in out]
    if missing:
        raise ValueError(f"arrays {', '.join(missing)} are missing")
    if len({m.rows for m in out.values()}) > 1:
        raise ValueError("arrays have different numbers of rows")
    return out


def planned(path: str, found: dict[str, Member], range_bytes: int) -> list[Range]:
    """Ranges of graphs: of at most range_bytes where arrays can be entered anywhere, else one."""
    rows, each = found["V"].rows, sum(m.row_bytes for m in found.values())
    step = max(1, range_bytes // max(1, each)) if all(m.offset >= 0 for m in found.values()) else max(1, rows)
    return [Range(path, a, min(rows, a + step)) for a in range(0, rows, step)]


def slices(file, found: dict[str, Member], start: int, stop: int, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """First row and arrays of consecutive slices of a range."""
    step = max(1, slice_bytes // max(1, sum(m.row_bytes for m in found.values())))
    streams, archive = {}, None
    if any(m.offset < 0 for m in found.values()):
        archive = zipfile.ZipFile(file)
        for name, m in found.items():
            f = streams[name] = archive.open(m.name)
            version = np.lib.format.read_magic(f)
            (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)

    def rows_of(name: str, a: int, b: int) -> np.ndarray:
        m = found[name]
        size = (b - a) * m.row_bytes
        if name in streams:
            data = _exactly(streams[name], size)
        else:
            file.seek(m.offset + a * m.row_bytes)
            data = _exactly(file, size)
        return np.frombuffer(data, dtype=m.dtype).reshape(b - a, *m.shape)

    for a in range(start, stop, step):
        b = min(stop, a + step)
        yield a, {name: rows_of(name, a, b) for name in found}
    if archive:
        archive.close()


def _exactly(f, size: int) -> bytes:
    parts, left = [], size
    while left:
        part = f.read(left)
        if not part:
            raise ValueError("an archive ends before its arrays do")
        parts.append(part)
        left -= len(part)
    return b"".join(parts)


class NpzReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, slice_bytes: int):
        self.path, self.range_bytes, self.slice_bytes = path, range_bytes, slice_bytes

    def partitions(self) -> list[Range]:
        out = []
        for path in archives(self.path):
            with _opened(path) as f:
                out += planned(path, members(f), self.range_bytes)
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark asks once where no range was planned
            return
        name = part.path.rsplit("/", 1)[-1]
        with _opened(part.path) as f:
            found = members(f)
            for first, z in slices(f, found, part.start, part.stop, self.slice_bytes):
                rows = [graph_row(f"{name}#{first + i}", z, i) for i in range(len(z["V"]))]
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


_SCHEMA = pa.schema(
    [("graph_id", pa.string()), ("n1", pa.int32()), ("n2", pa.int32()), ("n", pa.int32()), ("label", pa.int32()), ("tag", pa.string()), ("x", pa.list_(pa.list_(pa.float32()))),
     ("src", pa.list_(pa.int32())), ("dst", pa.list_(pa.int32())), ("attr", pa.list_(pa.list_(pa.float32())))]
)


class NpzSource(DataSource):
    """`spark.read.format("npz").load(path)`: a row a graph. Options rangeBytes and sliceBytes."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return GRAPH_ROW

    def reader(self, schema) -> NpzReader:
        option = lambda n, d: int(self.options.get(n, d))
        return NpzReader(self.options["path"], option("rangeBytes", RANGE_BYTES), option("sliceBytes", SLICE_BYTES))


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, slice_bytes: int = SLICE_BYTES) -> Dataset:
    """The tables of a path's archives, as `datasets.read_npz` gives them."""
    return tables_of(graphs(spark, path, range_bytes, slice_bytes))


def graphs(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """A row a graph, as the archives have them."""
    spark.dataSource.register(NpzSource)
    return spark.read.format("npz").option("rangeBytes", range_bytes).option("sliceBytes", slice_bytes).load(path)
