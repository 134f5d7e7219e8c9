"""The binary formats, all little-endian."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Element type and Spark type of the vector formats.
ELEMENTS = {"fbin": ("<f4", "float"), "u8bin": ("u1", "smallint"), "i8bin": ("i1", "tinyint"), "fvecs": ("<f4", "float"), "bvecs": ("u1", "smallint"), "ivecs": ("<i4", "int")}
TABLES = {"ibin": "qid bigint, rank int, id bigint, dist float", "range": "qid bigint, ids array<bigint>", "graph": "id bigint, nbrs array<bigint>"}


def _open(path: str):
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(at)


def read_header(path: str) -> tuple[int, int]:
    """The two numbers a file starts with: rows and columns, rows and k, rows and total, or rows and largest degree."""
    with _open(path) as f:
        n, d = np.frombuffer(f.read(8), "<u4")
    return int(n), int(d)


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class VectorFile(DataSource):
    """Options: path, kind, rows (rows of a partition, 100 000 by default), max_rows."""

    @classmethod
    def name(cls) -> str:
        return "vectorfile"

    def schema(self) -> str:
        kind = self.options.get("kind", "")
        if kind in ELEMENTS:
            return f"id bigint, vec array<{ELEMENTS[kind][1]}>"
        if kind in TABLES:
            return TABLES[kind]
        raise ValueError(f"unknown kind: {kind!r}")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = options["path"], options["kind"]
        self.rows, self.most = int(options.get("rows", 100_000)), int(options.get("max_rows", -1))

    def _count(self) -> int:
        with _open(self.path) as f:
            size = f.size()
            if size == 0:
                return 0
            n = int(np.frombuffer(f.read(4), "<u4")[0])
        if self.kind.endswith("vecs"):  # the first number is the length of a row
            n = size // (4 + n * np.dtype(ELEMENTS[self.kind][0]).itemsize)
        return min(n, self.most) if self.most >= 0 else n

    def partitions(self) -> list[Range]:
        n = self._count()
        return [Range(i, min(n, i + self.rows)) for i in range(0, n, self.rows)] or [Range(0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        n = part.last - part.first
        if n <= 0:
            return
        with _open(self.path) as f:
            total, width = np.frombuffer(f.read(8).ljust(8, b"\0"), "<u4").tolist()

            def block(at: int, kind: str, count: int) -> np.ndarray:
                f.seek(at)
                return np.frombuffer(f.read(count * np.dtype(kind).itemsize), kind)

            ids = pa.array(np.arange(part.first, part.last))
            if self.kind in ELEMENTS:
                kind, to = ELEMENTS[self.kind]
                item = np.dtype(kind).itemsize
                if self.kind.endswith("bin"):
                    values = block(8 + part.first * width * item, kind, n * width)
                else:
                    width, row = total, 4 + total * item
                    values = np.ascontiguousarray(block(part.first * row, "u1", n * row).reshape(n, row)[:, 4:]).view(kind).ravel()
                arrow = {"float": pa.float32(), "smallint": pa.int16(), "tinyint": pa.int8(), "int": pa.int32()}[to]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)), pa.array(values).cast(arrow))
                yield pa.RecordBatch.from_arrays([ids, lists], ["id", "vec"])
            elif self.kind == "ibin":
                own = block(8 + part.first * width * 4, "<i4", n * width)
                dist = block(8 + (total + part.first) * width * 4, "<f4", n * width)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(part.first, part.last), width)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), n)), pa.array(own.astype(np.int64)), pa.array(dist)], ["qid", "rank", "id", "dist"])
            else:
                sizes = block(8, "<u4", part.last).astype(np.int64)  # offsets are sums of all sizes before
                edge = np.concatenate(([0], np.cumsum(sizes[part.first :])))
                values = block(8 + 4 * total + 4 * int(sizes[: part.first].sum()), "<u4", int(edge[-1])).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([ids, lists], ["qid", "ids"] if self.kind == "range" else ["id", "nbrs"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VectorFile)


def _rows(df: DataFrame, order: str):
    """Rows in order, a partition at a time on the driver: interchange files are single files."""
    return df.orderBy(order).toLocalIterator()


def write_vectors(df: DataFrame, path: str, kind: str) -> int:
    """id, vec in the order of ids. Returns the number of rows."""
    element, n, width = ELEMENTS[kind][0], 0, 0
    with open(path, "wb") as f:
        if kind.endswith("bin"):
            f.write(bytes(8))
        for row in _rows(df.select("id", "vec"), "id"):
            v = np.array(row["vec"], element)
            width = len(v) if n == 0 else width
            if len(v) != width:
                raise ValueError("vectors differ in length")
            f.write((np.array([width], "<i4").tobytes() if kind.endswith("vecs") else b"") + v.tobytes())
            n += 1
        if kind.endswith("bin"):
            f.seek(0)
            f.write(np.array([n, width], "<u4").tobytes())
    return n


def write_neighbours(df: DataFrame, path: str, k: int) -> int:
    """qid, rank, id, dist with exactly k rows a query."""
    rows = df.where(f"rank <= {k}").selectExpr("qid", "rank", "id", "dist").orderBy("qid", "rank").toLocalIterator()
    ids, dist = [], []
    for r in rows:
        ids.append(r["id"])
        dist.append(r["dist"])
    with open(path, "wb") as f:
        f.write(np.array([len(ids) // k, k], "<i4").tobytes() + np.array(ids, "<i4").tobytes() + np.array(dist, "<f4").tobytes())
    return len(ids) // k


def _write_ragged(df: DataFrame, key: str, values: str, path: str, second) -> int:
    sizes, out = [], []
    for row in _rows(df.select(key, values), key):
        sizes.append(len(row[values]))
        out.append(np.array(row[values], "<u4"))
    with open(path, "wb") as f:
        f.write(np.array([len(sizes), second(sizes)], "<u4").tobytes() + np.array(sizes, "<u4").tobytes() + b"".join(o.tobytes() for o in out))
    return len(sizes)


def write_ranges(df: DataFrame, path: str) -> int:
    return _write_ragged(df, "qid", "ids", path, sum)


def write_graph(df: DataFrame, path: str) -> int:
    return _write_ragged(df, "id", "nbrs", path, lambda s: max(s, default=0))
