"""PLY point clouds as a Spark data source (``format("ply")``).

Reading: the header is parsed on the driver, which gives the schema and, for
binary files, fixed-width row ranges as partitions.  Ascii, little- and
big-endian files are read; list properties of later elements are skipped.
Writing: tasks write body chunks, the commit puts the header in front.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from sparkogram.sources.files import delete_folder, place, read_bytes

#: PLY property types and their NumPy codes (fixed values of the format).
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
_RENAME = {"red": "r", "green": "g", "blue": "b"}


@dataclass(frozen=True)
class Header:
    form: str
    rows: int
    names: tuple[str, ...]
    codes: tuple[str, ...]
    start: int  # of the body

    @property
    def dtype(self) -> np.dtype:
        order = ">" if self.form == "binary_big_endian" else "<"
        return np.dtype([(n, order + c) for n, c in zip(self.names, self.codes, strict=True)])


def parse_header(path: str) -> Header:
    """Format, vertex count and vertex properties; ValueError for anything that is no PLY."""
    data, size = read_bytes(path, 0, 1 << 16), 1 << 16
    end = data.find(b"end_header")
    if not data.startswith(b"ply") or end < 0 or size < end:
        raise ValueError(f"no PLY header in {path}")
    start = data.index(b"\n", end) + 1
    form, rows, inside, names, codes = "", 0, False, [], []
    for line in data[:end].decode("ascii", "replace").splitlines()[1:]:
        part = line.split()
        if part[:1] == ["format"]:
            form = part[1]
        elif part[:1] == ["element"]:
            inside = part[1] == "vertex"
            rows = int(part[2]) if inside else rows
        elif part[:1] == ["property"] and inside:
            if part[1] == "list":
                raise ValueError("list property in the vertex element")
            names.append(_RENAME.get(part[2], part[2]))
            codes.append(TYPES[part[1]])
    if form not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise ValueError(f"unknown PLY format {form!r}")
    return Header(form, rows, tuple(names), tuple(codes), start)


def count_vertices(path: str) -> int:
    """Vertex count from the header alone."""
    return parse_header(path).rows


def _field(name: str, code: str) -> StructField:
    kind = {"f4": FloatType(), "f8": DoubleType(), "u4": LongType()}.get(code, IntegerType())
    return StructField(name, kind)


@dataclass
class Rows(InputPartition):
    first: int
    count: int


class PlyReader(DataSourceReader):
    def __init__(self, path: str, header: Header, per_part: int):
        self.path, self.header, self.per_part = path, header, per_part

    def partitions(self) -> list[Rows]:
        step = self.per_part if self.header.form != "ascii" else max(self.header.rows, 1)
        return [Rows(at, min(step, self.header.rows - at)) for at in range(0, self.header.rows, step)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        h = self.header
        if not partition.count:
            return
        if h.form == "ascii":
            lines = read_bytes(self.path, h.start).splitlines()[: h.rows]
            table = np.array([[float(x) for x in line.split()[: len(h.names)]] for line in lines]).reshape(-1, len(h.names))
            columns = {n: table[:, i] for i, n in enumerate(h.names)}
        else:
            width = h.dtype.itemsize
            body = read_bytes(self.path, h.start + partition.first * width, partition.count * width)
            table = np.frombuffer(body, h.dtype)
            columns = {n: table[n] for n in h.names}
        pid = np.arange(partition.first, partition.first + len(table), dtype=np.int64)
        arrays = [pa.array(pid)]
        for n, c in zip(h.names, h.codes, strict=True):
            kind = {"f4": np.float32, "f8": np.float64, "u4": np.int64}.get(c, np.int32)
            arrays.append(pa.array(columns[n].astype(kind)))
        yield pa.RecordBatch.from_arrays(arrays, names=["pid", *h.names])


@dataclass
class Part(WriterCommitMessage):
    order: int
    name: str
    rows: int


class PlyWriter(DataSourceWriter):
    """Binary little-endian PLY: float x y z, and uchar colours when r, g, b are there (15 bytes a vertex)."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.parts = path, f"{path}.parts-{uuid.uuid4().hex}"
        self.colours = {"r", "g", "b"} <= set(names)

    def _dtype(self) -> np.dtype:
        colour = [(c, "u1") for c in "rgb"] if self.colours else []
        return np.dtype([(c, "<f4") for c in "xyz"] + colour)

    def write(self, iterator: Iterator) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = place(self.parts)
        system.create_dir(folder, recursive=True)
        name, rows, dtype = f"{folder}/{context.partitionId():08d}-{context.taskAttemptId()}", 0, self._dtype()
        with system.open_output_stream(name) as f:
            held: list[tuple] = []
            for row in iterator:
                held.append(tuple(row[n] for n in dtype.names))
                if len(held) == 65536:
                    f.write(np.array(held, dtype).tobytes())
                    rows, held = rows + len(held), []
            f.write(np.array(held, dtype).tobytes())
        return Part(context.partitionId(), name, rows + len(held))

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.order)
        total = sum(m.rows for m in parts)
        if not total:
            self.abort(messages)
            raise ValueError("a PLY file needs at least one point")
        colour = "".join(f"property uchar {c}\n" for c in ("red", "green", "blue")) if self.colours else ""
        head = f"ply\nformat binary_little_endian 1.0\nelement vertex {total}\n" + "".join(f"property float {c}\n" for c in "xyz") + colour + "end_header\n"
        system, name = place(self.path)
        if "/" in name:
            system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(name) as out:
            out.write(head.encode())
            for m in parts:
                with system.open_input_stream(m.name) as part:
                    while chunk := part.read(1 << 22):
                        out.write(chunk)
        delete_folder(self.parts)

    def abort(self, messages: list) -> None:
        delete_folder(self.parts)


class PlyDataSource(DataSource):
    """``spark.read.format("ply").load(path)`` and ``df.write.format("ply").mode("append").save(path)``.

    Option ``rows_per_partition`` bounds a read task (default one million).
    """

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> StructType:
        h = parse_header(self.options["path"])
        return StructType([StructField("pid", LongType()), *(_field(n, c) for n, c in zip(h.names, h.codes, strict=True))])

    def reader(self, schema: StructType) -> PlyReader:
        path = self.options["path"]
        return PlyReader(path, parse_header(path), int(self.options.get("rows_per_partition", 1_000_000)))

    def writer(self, schema: StructType, overwrite: bool) -> PlyWriter:
        return PlyWriter(self.options["path"], schema.names)
