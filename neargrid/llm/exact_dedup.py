"""Grace hash deduplication of whole texts.

Texts are equal when they are identical after deleting space and the characters 09-0D. Of equal texts, the row with the
most code points in its original text stays, then the smallest doc_id (null last), then the first row of the table.

1. Where documents are read, a bounded open-addressing table joins equal texts of one task; when it is full it is
   written out and begun anew. This leaves one *record* (content, count, best row) for each content and filling, and
   one narrow row for each document that names its record. A group with a third of all rows shrinks to one record a task.
2. Records fall into buckets by their hash. A bucket whose contents exceed `table_bytes` is spilled to files of
   its own, divided by further digits of the hash, again and again, until it fits (or holds one hash only).
3. Each bucket goes through an open-addressing table that compares complete contents; memory holds one bucket's
   distinct contents. It returns the group of each record.
4. Documents meet their record's group by the record's number, which no more rows share than one task reads.

Null counts as empty; all empty texts are one group. Repeated rows: one stays. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage, task_count

SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of distinct contents that one table holds.
TABLE_BYTES = 32 << 20
#: Buckets into which a bucket that doesn't fit is divided.
FAN_OUT = 64

ROWS = "kind int, record long, doc_id long, row long, hash long, content binary, size long, n long, best_chars long, best_id long, best_row long"
GROUPS = "record long, keep_id long, keep_row long, keep_chars long, group_size long, text_sha256 string"


class OpenTable:
    """Open addressing with linear probing; a slot holds the number of a content, and complete contents are compared."""

    def __init__(self, slots: int = 1 << 12):
        self.slots = [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def place(self, h: int, content: bytes) -> tuple[int, bool]:
        """The number of this content, and whether it is new."""
        mask = len(self.slots) - 1
        i = h & mask
        while (k := self.slots[i]) >= 0:
            if self.hashes[k] == h and self.contents[k] == content:
                return k, False
            i = (i + 1) & mask
        k = self.slots[i] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content)
        if 3 * len(self.contents) > 2 * len(self.slots):
            self._grow()
        return k, True

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for k, h in enumerate(self.hashes):
            i = h & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = k


def better(a: tuple, b: tuple) -> bool:
    """Whether row a = (code points, doc_id, row number) is to stay rather than b."""
    return (-a[0], a[1] is None, a[1] or 0, a[2]) < (-b[0], b[1] is None, b[1] or 0, b[2])


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def combine(rows: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Rows of kind 0 (a document and its record) and of kind 1 (a record). rows: doc_id, text, and a row number."""
    small_batches(rows.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        table, best, count = OpenTable(), [], []

        def records():
            for k in range(0, len(best), 512):
                yield _batch(ROWS, [(1, first + i, None, None, table.hashes[i] - (1 << 63), table.contents[i], len(table.contents[i]), count[i], *best[i]) for i in range(k, min(k + 512, len(best)))])

        for batch in batches:
            out = []
            for name, text, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                content = text.encode("utf-8", "surrogatepass").translate(None, SPACES)
                k, new = table.place(xxhash.xxh3_64_intdigest(content), content)
                own = (len(text), name, row)
                if new:
                    best.append(own)
                    count.append(1)
                else:
                    count[k] += 1
                    if better(own, best[k]):
                        best[k] = own
                out.append((0, first + k, name, row, None, None, None, None, None, None, None))
            yield _batch(ROWS, out)
            if table.bytes > table_bytes:
                yield from records()
                first += len(best)
                table, best, count = OpenTable(), [], []
        yield from records()

    return rows.mapInArrow(run, ROWS)


def buckets(records: DataFrame, total: int, table_bytes: int, fan_out: int = FAN_OUT) -> DataFrame:
    """Records with a column bucket, such that the contents of a bucket fit a table or have one hash. total: their bytes."""
    first = max(1, -(-2 * total // table_bytes))
    part = records.withColumn("bucket", F.pmod("hash", F.lit(first)))
    done, level = None, 0
    while True:
        sizes = part.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        big = sizes.where((F.col("bytes") > table_bytes) & (F.col("low") < F.col("high"))).select("bucket")
        if big.isEmpty():
            return part if done is None else done.unionByName(part)
        fits = part.join(big, "bucket", "left_anti").select(*part.columns)
        done = fits if done is None else done.unionByName(fits)
        level += 1
        digit = F.pmod(F.xxhash64(F.col("hash"), F.lit(level)), F.lit(fan_out))
        part = stage(part.join(big, "bucket", "left_semi").select(*part.columns).withColumn("bucket", F.xxhash64(F.col("bucket"), digit)))


def group_records(bucketed: DataFrame, tasks: int) -> DataFrame:
    """The group of each record: every bucket goes through one open-addressing table."""

    def run(batches):
        now, table, members, best, count = None, OpenTable(), [], [], []

        def groups():
            digests = [hashlib.sha256(c).hexdigest() for c in table.contents]
            for k in range(0, len(members), 4096):
                yield _batch(GROUPS, [(r, best[i][1], best[i][2], best[i][0], count[i], digests[i]) for r, i in members[k : k + 4096]])

        for batch in batches:
            for bucket, record, h, content, n, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from groups()
                    now, table, members, best, count = bucket, OpenTable(), [], [], []
                k, new = table.place(h + (1 << 63), content)
                members.append((record, k))
                if new:
                    best.append(tuple(own))
                    count.append(n)
                else:
                    count[k] += n
                    if better(tuple(own), best[k]):
                        best[k] = tuple(own)
        yield from groups()

    wanted = bucketed.select("bucket", "record", "hash", "content", "n", "best_chars", "best_id", "best_row")
    return wanted.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, GROUPS)


def group_rows(rows: DataFrame, table_bytes: int = TABLE_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """doc_id, row, keep_id, keep_row, group_size, text_sha256 for rows of doc_id (long), text and row."""
    found = stage(combine(rows, table_bytes), ["kind"])
    records = found.where("kind = 1")
    total = records.agg(F.sum("size")).first()[0] or 0
    groups = group_records(buckets(records, total, table_bytes, fan_out), task_count(rows.sparkSession, total))
    return found.where("kind = 0").select("record", "doc_id", "row").join(groups, "record")


def group_texts(docs: DataFrame, table_bytes: int = TABLE_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """Every document with the row of its group that stays."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row"))
    return group_rows(rows, table_bytes, fan_out).selectExpr("doc_id", "keep_id", "group_size", "row = keep_row AS kept", "text_sha256")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One document of each group of equal texts, with all its columns.

    Rows are numbered and stored once, so that what stays is found by its number and texts are not hashed again.
    """
    columns = docs.columns
    named = stage(docs.toDF(*[f"c{i}" for i in range(len(columns))]).withColumn("row", F.monotonically_increasing_id()))
    of = {c: f"c{i}" for i, c in enumerate(columns)}
    groups = group_rows(named.select(F.col(of["doc_id"]).cast("long").alias("doc_id"), F.col(of["text"]).alias("text"), "row"), **options)
    kept = groups.where("row = keep_row").select("row")
    return named.join(kept, "row", "left_semi").drop("row").toDF(*columns)
