"""Row-major binary vector files as a Spark data source ("bigann"), for reading and writing, on any file system of `files`.

Layout, little-endian: rows u32, second u32, then the rows. Extensions: .fbin (f32), .u8bin, .i8bin, .b1bin (bits, 8 a byte; the
second header field counts bits), .ibin (neighbours u32), .i32bin (keys u32). A path may be a pattern: its files are read in
natural order as one table, and the first pins element type and dimensions.

Reading splits files into ranges of rows, one task each; a task reads its range only, and of each row only the leading
bytes that `dims` asks for. Conditions on the row number are pushed down to the ranges.

Tasks write files of at most PART_BYTES, each at once with its header. What becomes of them is for the driver to say when all tasks are done:

* option `folder`: they stay where they are, below a folder with the name of the target, and a manifest of their names and sizes is added
  as a new version. No byte is copied or moved, files of failed attempts are in no manifest, `append` adds files and
  `overwrite` begins anew. Such a folder is read like a file, without opening its files for their sizes, and
  `readStream` gives each committed file once. One writer at a time.
* option `shards`: they become `name_<first row>.ext` files of their own, which a pattern reads again as one table.
* neither: they are joined behind one header (for files of moderate size).
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from . import files

HEADER = struct.Struct("<II")
ELEMENTS = {".fbin": "<f4", ".u8bin": "u1", ".i8bin": "i1", ".b1bin": "u1", ".ibin": "<u4", ".i32bin": "<u4"}
SCHEMAS = {
    ".fbin": "row bigint, vector array<float>",
    ".u8bin": "row bigint, vector array<smallint>",
    ".i8bin": "row bigint, vector array<tinyint>",
    ".b1bin": "row bigint, words array<bigint>, bits int",
    ".ibin": "query_id bigint, neighbors array<bigint>",
    ".i32bin": "row bigint, key bigint",
}
ROWS_PER_TASK = 1 << 18
#: Bytes of a file that a task writes, which it holds until its number of rows is known.
PART_BYTES = 128 << 20


class FormatError(ValueError):
    pass


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    second: int
    first: int  # global number of its first row


def extension(path: str) -> str:
    ext = os.path.splitext(path)[1]
    if ext not in ELEMENTS:
        raise FormatError(f"{path}: unknown extension {ext!r}; known: {sorted(ELEMENTS)}")
    return ext


def stride(ext: str, second: int) -> int:
    if ext == ".b1bin":
        return -(-second // 8)
    return np.dtype(ELEMENTS[ext]).itemsize * (1 if ext == ".i32bin" else second)


def expand(path: str) -> list[str]:
    found = files.expand(path)
    if not found:
        raise FormatError(f"no file matches {path}")
    return found


def manifest_version(folder: str) -> int:
    """The newest version of a folder's manifest, 0 if it has none."""
    return max((int(n[10:-5]) for n in files.names(folder) if n.startswith("_manifest-") and n.endswith(".json")), default=0)


def manifest(folder: str) -> list[dict]:
    """name, rows and second of the files of the newest version, in order."""
    version = manifest_version(folder)
    if not version:
        raise FormatError(f"{folder}: a folder without a manifest")
    with files.reading(f"{folder}/_manifest-{version:010d}.json") as f:
        return json.loads(f.read())["files"]


def shards(path: str) -> list[Shard]:
    out: list[Shard] = []

    def add(p: str, ext: str, rows: int, second: int) -> None:
        if out and (second != out[0].second or ext != extension(out[0].path)):
            raise FormatError(f"{p}: differs from {out[0].path} in dimensions or type")
        out.append(Shard(p, rows, second, out[-1].first + out[-1].rows if out else 0))

    for p in expand(path):
        ext = extension(p)
        if files.kind(p) == "folder":
            for part in manifest(p):
                add(f"{p}/{part['name']}", ext, part["rows"], part["second"])
            continue
        with files.reading(p) as f:
            head = f.read(HEADER.size)
        if len(head) < HEADER.size:
            raise FormatError(f"{p}: shorter than a header")
        rows, second = HEADER.unpack(head)
        if files.size(p) - HEADER.size < rows * stride(ext, second):
            raise FormatError(f"{p}: body too small for {rows} rows")
        add(p, ext, rows, second)
    return out


@dataclass
class RowRange(InputPartition):
    path: str
    second: int
    start: int  # in the file
    count: int
    first: int  # global number of the row at start


class BigAnnReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.shards, self.ext = shards(path), extension(expand(path)[0])
        self.low, self.high = int(options.get("from", 0)), int(options.get("to", 1 << 62))
        self.step = int(options.get("rowspertask", ROWS_PER_TASK))
        self.dims = int(options["dims"]) if "dims" in options else None
        self.names = [c.split()[0] for c in SCHEMAS[self.ext].split(", ")]

    def pushFilters(self, filters):
        """Comparisons of the row number with a number narrow the ranges that are read; the others go back to Spark."""
        for f in filters:
            whole = isinstance(getattr(f, "value", None), int) and getattr(f, "attribute", None) == (self.names[0],)
            if whole and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
            elif whole and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif whole and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            else:
                if isinstance(f, In) and f.attribute == (self.names[0],) and f.value and all(isinstance(v, int) for v in f.value):
                    self.low, self.high = max(self.low, min(f.value)), min(self.high, max(f.value) + 1)
                yield f

    def partitions(self):
        out = []
        for s in self.shards:
            a, b = max(0, self.low - s.first), min(s.rows, self.high - s.first)
            out += [RowRange(s.path, s.second, k, min(self.step, b - k), s.first + k) for k in range(a, b, self.step)]
        return out or [RowRange("", self.shards[0].second if self.shards else 0, 0, 0, 0)]

    def read(self, part: RowRange):
        size = stride(self.ext, part.second)
        dtype = np.dtype(ELEMENTS[self.ext])
        for a in range(part.start, part.start + part.count, 8192):
            n = min(8192, part.start + part.count - a)
            with files.reading(part.path) as f:
                if self.wanted(part.second) == size:
                    f.seek(HEADER.size + a * size)
                    raw = f.read(n * size)
                else:  # leading bytes only
                    raw = b"".join(f.read_at(self.wanted(part.second), HEADER.size + k * size) for k in range(a, a + n))
                x = np.frombuffer(raw, dtype).reshape(n, -1)
            rows = pa.array(np.arange(n, dtype=np.int64) + part.first + (a - part.start))
            yield pa.RecordBatch.from_arrays([rows, *self.columns(x, part.second)], names=[c.split()[0] for c in SCHEMAS[self.ext].split(", ")])

    def wanted(self, second: int) -> int:
        """Bytes of a row that are read: short prefixes of long rows are read one by one."""
        size = stride(self.ext, second)
        if self.dims is None or self.ext in (".ibin", ".i32bin"):
            return size
        some = stride(self.ext, self.dims)
        return some if size - some >= 4096 else size

    def columns(self, x: np.ndarray, second: int) -> list[pa.Array]:
        def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
            offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))

        if self.ext == ".i32bin":
            return [pa.array(x[:, 0].astype(np.int64))]
        if self.ext == ".ibin":
            return [lists(x.astype(np.int64), pa.int64())]
        if self.ext == ".b1bin":
            bits = self.dims or second
            wide = np.zeros((len(x), -(-bits // 64) * 8), dtype=np.uint8)
            wide[:, : -(-bits // 8)] = x[:, : -(-bits // 8)]
            return [lists(wide.view("<i8"), pa.int64()), pa.array(np.full(len(x), bits, dtype=np.int32))]
        x = x[:, : self.dims] if self.dims else x
        kind = {".fbin": pa.float32(), ".u8bin": pa.int16(), ".i8bin": pa.int8()}[self.ext]
        return [lists(x.astype(kind.to_pandas_dtype()), kind)]


class BigAnnStream(BigAnnReader, DataSourceStreamReader):
    """The files of a folder's manifest, each once, as they are committed."""

    def __init__(self, path: str, options: dict):
        if files.kind(path) != "folder":
            raise FormatError(f"{path}: a stream reads a folder with a manifest")
        self.path = path
        super().__init__(path, options)

    def initialOffset(self):
        return {"files": 0}

    def latestOffset(self):
        return {"files": len(manifest(self.path))}

    def partitions(self, start=None, end=None):
        every = shards(self.path)
        if len(every) < end["files"]:
            raise FormatError(f"{self.path}: has been overwritten since the stream began")
        self.shards = every[start["files"] : end["files"]]
        return super().partitions()

    def commit(self, end):
        pass


@dataclass
class Part(WriterCommitMessage):
    """The files that a task has written: path, rows, second, first row number."""

    made: list[tuple[str, int, int, int]]


class BigAnnWriter(DataSourceArrowWriter):
    """Rows are written in the order of their number within each task; tasks follow by their first number."""

    def __init__(self, path: str, overwrite: bool, layout: str = "one"):
        self.path, self.ext, self.overwrite, self.layout, self.token = path.rstrip("/"), extension(path), overwrite, layout, uuid.uuid4().hex

    def _rows(self, batch: pa.RecordBatch) -> tuple[np.ndarray, int]:
        """The rows of a batch as bytes, and the second field of the header."""
        values = batch.column(1)
        if self.ext == ".i32bin":
            return values.to_numpy().astype("<u4")[:, None].view(np.uint8), 1
        n = np.diff(values.offsets.to_numpy())
        if len(np.unique(n)) != 1:
            raise FormatError("rows differ in length")
        if self.ext == ".b1bin":
            bits = np.unique(batch.column(2).to_numpy())
            if len(bits) != 1:
                raise FormatError("rows differ in length")
            words = np.ascontiguousarray(values.flatten().to_numpy().astype("<i8").reshape(len(n), -1))
            return words.view(np.uint8)[:, : -(-int(bits[0]) // 8)], int(bits[0])
        x = values.flatten().to_numpy().astype(ELEMENTS[self.ext]).reshape(len(n), -1)
        return np.ascontiguousarray(x).view(np.uint8), x.shape[1]

    def _part(self, name: str) -> str:
        return f"{self.path}/part-{self.token}-{name}{self.ext}" if self.layout == "folder" else f"{self.path}.part-{self.token}-{name}"

    def write(self, iterator):
        from pyspark import TaskContext

        task = TaskContext.get()
        name, made, held, n, second, first, last = f"{task.partitionId()}-{task.attemptNumber()}", [], [], 0, 0, -1, -1

        def close() -> None:
            path = self._part(f"{name}-{len(made)}")
            with files.writing(path) as f:
                f.write(HEADER.pack(n, second))
                for data in held:
                    f.write(data)
            made.append((path, n, second, first))

        for batch in iterator:
            if not batch.num_rows:
                continue
            numbers = np.concatenate([[last], batch.column(0).to_numpy()])
            if (np.diff(numbers) <= 0).any():
                raise FormatError("rows must be sorted by number in each partition")
            last = int(numbers[-1])
            data, width = self._rows(batch)
            if first >= 0 and width != second:
                raise FormatError("rows differ in length")
            if n and (n + batch.num_rows) * data.shape[1] > PART_BYTES:
                close()
                held, n = [], 0
            first = first if n else int(numbers[1])
            second, n = width, n + batch.num_rows
            held.append(data.tobytes())
        if n:
            close()
        return Part(made)

    def commit(self, messages):
        parts = sorted((p for m in messages if m is not None for p in m.made), key=lambda p: p[3])
        if len({p[2] for p in parts}) > 1:
            raise FormatError("rows differ in length")
        {"folder": self._list, "shards": self._name, "one": self._join}[self.layout](parts)
        self._clean({p[0] for p in parts} if self.layout == "folder" else set())

    def _list(self, parts) -> None:
        """A new version of the manifest. It is written beside and moved, so that no reader sees half of it."""
        version = manifest_version(self.path)
        before = manifest(self.path) if version else []
        new = [{"name": path.rsplit("/", 1)[1], "rows": n, "second": second} for path, n, second, _ in parts]
        kept = [] if self.overwrite else before
        if kept and new and kept[0]["second"] != new[0]["second"]:
            raise FormatError(f"{self.path}: holds rows of another length")
        target = f"{self.path}/_manifest-{version + 1:010d}.json"
        with files.writing(f"{target}.tmp") as f:
            f.write(json.dumps({"files": kept + new}).encode())
        files.move(f"{target}.tmp", target)
        if self.overwrite:
            for part in before:
                files.remove(f"{self.path}/{part['name']}")

    def _name(self, parts) -> None:
        stem = os.path.splitext(self.path)[0]
        for path, _, _, first in parts:
            target = f"{stem}_{first:012d}{self.ext}"
            self._free(target)
            files.move(path, target)

    def _join(self, parts) -> None:
        self._free(self.path)
        rows = sum(p[1] for p in parts)
        if rows >= 1 << 32:
            raise FormatError("a file holds fewer than 2**32 rows; use the option folder or shards")
        with files.writing(f"{self.path}.tmp") as out:
            out.write(HEADER.pack(rows, parts[0][2] if parts else 0))
            for path, *_ in parts:
                with files.reading(path) as f:
                    f.seek(HEADER.size)
                    while block := f.read(1 << 20):
                        out.write(block)
        files.move(f"{self.path}.tmp", self.path)

    def _free(self, target: str) -> None:
        if files.kind(target) != "none" and not self.overwrite:
            raise FormatError(f"{target} exists")

    def _clean(self, keep: set[str]) -> None:
        """Delete the files of this write that are not kept, those of lost attempts among them."""
        folder, stem = (self.path, f"part-{self.token}") if self.layout == "folder" else (os.path.dirname(self.path) or ".", f"{os.path.basename(self.path)}.part-{self.token}")
        for name in files.names(folder):
            if name.startswith(stem) and f"{folder}/{name}" not in keep:
                files.remove(f"{folder}/{name}")

    def abort(self, messages):
        self._clean(set())


class BigAnn(DataSource):
    @classmethod
    def name(cls):
        return "bigann"

    def schema(self):
        return SCHEMAS[extension(expand(self.options["path"])[0])]

    def reader(self, schema):
        return BigAnnReader(self.options["path"], self.options)

    def streamReader(self, schema):
        return BigAnnStream(self.options["path"], self.options)

    def writer(self, schema, overwrite):
        asked = [name for name in ("folder", "shards") if self.options.get(name, "false").lower() == "true"]
        return BigAnnWriter(self.options["path"], overwrite, asked[0] if asked else "one")


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with conditions pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BigAnn)
