"""Tokenize documents and keep their ids as rANS blocks.

1. Every text is encoded where it is read; ids go to a table in the shared folder as 16-bit numbers.
2. Ids are counted over all documents; the counts (one row for each id of the vocabulary, at most 65,536) make the
   frequency table that all blocks share.
3. Documents are dealt by ranges of doc_id, sorted, and written as blocks (format: see `rans`).
4. `read_ids` decodes blocks independently; positions before each document come from the blocks' own sums.

Nulls count as empty texts, whose only id is the end id. Rows with one doc_id twice are two documents; a null doc_id
sorts first. Empty tables give an empty file set. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ragged, shared_dir, small_batches, stage
from .encoding import worker_encoder
from .rans import Coder, frequencies

END = 2
#: Ids of a block; a block ends with the document that reaches this number.
BLOCK_IDS = 1 << 20
BLOCKS = "shard int, block long, n_docs long, n_ids long, doc_ids binary, has_id binary, data binary"


def encode_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end: int = END) -> DataFrame:
    """doc_id and ids (little-endian unsigned 16-bit numbers), the end id behind each document."""
    small_batches(docs.sparkSession)

    def run(batches):
        encoder = worker_encoder(vocabulary)
        for batch in batches:
            ids, lengths = encoder.encode(batch.column(1))
            bounds = ragged(lengths)
            rows = [np.append(ids[a:b], np.uint16(end)).astype("<u2").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def count_ids(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs. The driver gets one row for each id of the vocabulary."""

    def run(batches):
        counts = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            counts += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u2"), minlength=1 << 16)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen])], names=["id", "n"])

    rows = encoded.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << 16, dtype=np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def write_ids(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end: int = END) -> None:
    """Write path/blocks and path/table (id, slots) for all documents."""
    spark = docs.sparkSession
    encoded = stage(encode_documents(docs, vocabulary, end))
    slots = frequencies(count_ids(encoded))
    seen = np.flatnonzero(slots)
    spark.createDataFrame([(int(i), int(slots[i])) for i in seen], "id int, slots int").coalesce(1).write.parquet(f"{path}/table")

    def run(batches):
        from pyspark import TaskContext

        shard, coder = TaskContext.get().partitionId(), Coder(slots)
        names: list[int | None] = []
        parts: list[bytes] = []
        held = block = 0

        def full():
            lengths = np.array([len(x) // 2 for x in parts], dtype=np.int64)
            ids = np.frombuffer(b"".join(parts), "<u2")
            doc_ids = np.array([x or 0 for x in names], dtype="<i8").tobytes()
            has = np.array([x is not None for x in names], dtype=np.uint8).tobytes()
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int64()), "n_docs": pa.array([len(names)], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "doc_ids": [doc_ids], "has_id": [has], "data": [coder.encode(ids, lengths)]})

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                parts.append(ids)
                held += len(ids) // 2
                if held >= BLOCK_IDS:
                    yield full()
                    names, parts, held, block = [], [], 0, block + 1
        if names:
            yield full()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Documents of a written file set: doc_id, start (ids before it), n_tokens and ids, or with digest ids_crc32.

    Blocks are decoded where they are read. The ids before each block follow from the blocks' sizes alone: sums over
    shards, then over the blocks of a shard.
    """
    slots = np.zeros(1 << 16, dtype=np.int64)
    for r in spark.read.schema("id int, slots int").parquet(f"{path}/table").collect():  # one row an id at most
        slots[r["id"]] = r["slots"]
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    sizes = blocks.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).selectExpr("shard", "sum(n_ids) OVER (ORDER BY shard) - n_ids AS before")
    within = sizes.selectExpr("shard", "block", "sum(n_ids) OVER (PARTITION BY shard ORDER BY block) - n_ids AS inside")
    starts = within.join(shards, "shard").selectExpr("shard", "block", "before + inside AS first")

    def run(batches):
        coder = Coder(slots)
        for batch in batches:
            for row in batch.to_pylist():
                ids, lengths = coder.decode(row["data"])
                bounds = ragged(lengths)
                has = np.frombuffer(row["has_id"], np.uint8)
                names = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=has == 0)
                wide = ids.astype("<u4")
                pairs = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                if digest:
                    last = pa.array([zlib.crc32(wide[a:b].data.cast("B") if b > a else b"") for a, b in pairs], pa.int64())
                else:
                    last = pa.array([wide[a:b].tolist() for a, b in pairs], pa.list_(pa.int32()))
                n = len(lengths)
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int64()), names, pa.array(bounds[:-1]), pa.array(lengths), last], names=["shard", "block", "doc_id", "inside", "n_tokens", kind])

    kind = "ids_crc32" if digest else "ids"
    columns = f"shard int, block long, doc_id long, inside long, n_tokens long, {kind} {'long' if digest else 'array<int>'}"
    decoded = blocks.select("shard", "block", "doc_ids", "has_id", "data").mapInArrow(run, columns)
    return decoded.join(starts, ["shard", "block"]).selectExpr("doc_id", "first + inside AS start", "n_tokens", kind)


def token_ids(docs: DataFrame) -> DataFrame:
    """Write the ids of all documents below the shared folder and return what the files hold, as digests."""
    path = shared_dir(docs.sparkSession)
    write_ids(docs, path)
    return read_ids(docs.sparkSession, path, digest=True)
