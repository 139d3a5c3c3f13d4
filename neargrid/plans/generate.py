"""Synthetic vectors whose values depend on (seed, row, dimension) alone, whatever the partitioning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Least first argument of the logarithm in Box-Muller.
EPSILON = float(np.finfo(np.float32).eps)


def mixed(rows: np.ndarray, columns: int, seed: int, stream: int) -> np.ndarray:
    """64 random bits for each row and column, from a counter."""
    with np.errstate(over="ignore"):
        x = rows.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(columns, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
        x += np.uint64((seed * 0x2545F4914F6CDD1D + stream * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def uniform(rows: np.ndarray, columns: int, seed: int, stream: int) -> np.ndarray:
    return (mixed(rows, columns, seed, stream) >> np.uint64(11)) * 2.0**-53


def normal(rows: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """Standard normal values (Box-Muller)."""
    u, v = (uniform(rows, -(-dims // 2), seed, s) for s in (0, 1))
    r = np.sqrt(-2 * np.log(np.maximum(u, EPSILON)))
    return np.stack([r * np.cos(2 * np.pi * v), r * np.sin(2 * np.pi * v)], axis=2).reshape(len(rows), -1)[:, :dims]


def _vectors(spark: SparkSession, first: int, count: int, dims: int, values) -> DataFrame:
    def run(batches):
        for batch in batches:
            x = values(batch.column(0).to_numpy()).astype(np.float32)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * dims)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["row", "vector"])

    return spark.range(first, first + count).mapInArrow(run, "row bigint, vector array<float>")


def embedded(spark: SparkSession, count: int, dims: int, inner: int, noise: float = 0.05, seed: int = 42, first: int = 0) -> DataFrame:
    """row, vector array<float>: normal values of `inner` dimensions in a fixed linear image of `dims`, with some noise, so
    that rows have as much structure as embeddings have."""
    if count < 0 or not 1 <= inner <= dims:
        raise ValueError("count must not be negative and inner in 1..dims")
    shape = normal(np.arange(inner), dims, seed + 1)

    def values(rows):
        x = normal(rows, inner + dims, seed)
        return x[:, :inner] @ shape + noise * x[:, inner:]

    return _vectors(spark, first, count, dims, values)


def gaussian(spark: SparkSession, count: int, dims: int, seed: int = 42, first: int = 0) -> DataFrame:
    """row, vector array<float> with standard normal values (Box-Muller)."""
    if count < 0 or dims < 1:
        raise ValueError("count must not be negative and dims at least 1")

    return _vectors(spark, first, count, dims, lambda rows: normal(rows, dims, seed))


def clustered_bits(spark: SparkSession, count: int, bits: int, clusters: int = 256, noise: float = 0.1, seed: int = 42, first: int = 0) -> DataFrame:
    """row, words array<bigint>, bits: random centres with each bit flipped with probability floor(256 noise) / 256."""
    if bits < 1 or bits % 8 or clusters < 1 or not 0 <= noise <= 1:
        raise ValueError("bits must be a multiple of 8, clusters at least 1, noise in 0..1")
    threshold, words = int(noise * 256), -(-bits // 64)
    last = np.uint64((1 << (bits - 64 * (words - 1))) - 1) if bits % 64 else np.uint64(0xFFFFFFFFFFFFFFFF)

    def run(batches):
        centres = mixed(np.arange(clusters), words, seed, 7)
        for batch in (b.slice(a, 4096) for b in batches for a in range(0, b.num_rows, 4096)):
            rows = batch.column(0).to_numpy()
            of = (mixed(rows, 1, seed, 8)[:, 0] % np.uint64(clusters)).astype(np.int64)
            flips = (mixed(rows, words * 64, seed, 9) & np.uint64(255)) < np.uint64(threshold)
            mask = (flips.reshape(len(rows), words, 64).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
            x = centres[of] ^ mask
            x[:, -1] &= last
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.view(np.int64).ravel())), pa.array(np.full(len(rows), bits, dtype=np.int32))], names=["row", "words", "bits"])

    return spark.range(first, first + count).mapInArrow(run, "row bigint, words array<bigint>, bits int")


#: Bytes and bits of the known molecule fingerprints.
FINGERPRINTS = {"maccs": (21, 168), "pubchem": (111, 888), "ecfp4": (256, 2048), "fcfp4": (256, 2048)}


def fingerprints(df: DataFrame, name: str) -> DataFrame:
    """Fixed-size binary fingerprints to row-major words; a value of another size is an error."""
    size, bits = FINGERPRINTS[name]

    def run(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            if any(x is None or len(x) != size for x in raw):
                raise ValueError(f"{name} values must have {size} bytes")
            wide = np.zeros((len(raw), -(-size // 8) * 8), dtype=np.uint8)
            wide[:, :size] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, size)
            words = wide.view("<i8")
            offsets = pa.array(np.arange(len(raw) + 1, dtype=np.int32) * words.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(words.ravel())), pa.array(np.full(len(raw), bits, dtype=np.int32))], names=["row", "words", "bits"])

    return df.select("row", name).mapInArrow(run, "row bigint, words array<bigint>, bits int")


def binary_embeddings(df: DataFrame, column: str, width: int = 128) -> DataFrame:
    """(row, list of `width` bytes) to row-major words; a value of another width is an error."""

    def run(batches):
        for batch in batches:
            values = batch.column(1)
            n = np.diff(values.offsets.to_numpy())
            if values.null_count or (n != width).any():
                raise ValueError(f"{column} values must have {width} bytes")
            raw = values.flatten().to_numpy().astype(np.int64)
            if ((raw < 0) | (raw > 255)).any():
                raise ValueError(f"{column} values must be bytes")
            wide = np.zeros((len(n), -(-width // 8) * 8), dtype=np.uint8)
            wide[:, :width] = raw.reshape(len(n), width)
            words = wide.view("<i8")
            offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * words.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(words.ravel())), pa.array(np.full(len(n), 8 * width, dtype=np.int32))], names=["row", "words", "bits"])

    return df.select("row", F.col(column).cast("array<int>")).mapInArrow(run, "row bigint, words array<bigint>, bits int")


def corpus(df: DataFrame, path: str, vector: str, text: str, width: int = 128, kind: str | None = None, queries: int = 0, k: int = 10) -> None:
    """Write path/base_*.b1bin and path/text, in which line n of the files taken in order is the escaped text of row n.

    kind: a fingerprint's name if `vector` is binary; else `vector` is a list of `width` bytes. queries: so many rows, sampled without
    replacement, go to path/query.b1bin as well, and the numbers of their k nearest base rows by Hamming distance to
    path/groundtruth.ibin.
    """
    from ..functions.text import escaped_line
    from ..operators import sampling
    from ..sources import bigann

    spark = df.sparkSession
    bigann.register(spark)
    ranged = df.repartitionByRange("row").sortWithinPartitions("row")
    words = fingerprints(ranged.withColumnRenamed(vector, kind), kind) if kind else binary_embeddings(ranged, vector, width)
    words.write.format("bigann").option("shards", "true").mode("append").save(f"{path}/base.b1bin")
    ranged.select(escaped_line(F.coalesce(text, F.lit(""))).alias("value")).write.text(f"{path}/text")
    if queries:
        base = spark.read.format("bigann").load(f"{path}/base_*.b1bin")
        some = sampling.sample(base, queries)  # a stated query set, so one task may number it
        place = F.row_number().over(Window.orderBy(sampling.row_hash(F.col("row")), "row")) - 1
        some.withColumn("row", place.cast("bigint")).coalesce(1).sortWithinPartitions("row").write.format("bigann").mode("append").save(f"{path}/query.b1bin")
        asked = spark.read.format("bigann").load(f"{path}/query.b1bin")
        ground_truth(base.withColumnRenamed("words", "vector"), asked.withColumnRenamed("words", "vector"), k, "hamming", path)


def ground_truth(base: DataFrame, queries: DataFrame, k: int, metric: str, path: str) -> None:
    """Write the row numbers of each query's k nearest as path/groundtruth.ibin. base, queries: row, vector."""
    from ..operators.knn import check_k, knn

    sizes = [df.agg(F.count("*"), F.max(F.size("vector"))).first() for df in (base, queries)]
    check_k(k, sizes[0][0], sizes[0][1], sizes[1][1])
    found = knn(base.select(F.col("row").alias("key"), "vector"), queries.select(F.col("row").alias("query_id"), "vector"), k, metric)
    wide = found.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "key"))), lambda s: s["key"]).alias("neighbors"))  # k a query
    wide.repartitionByRange("query_id").sortWithinPartitions("query_id").write.format("bigann").mode("append").save(f"{path}/groundtruth.ibin")


def dataset(spark: SparkSession, base: DataFrame, queries: DataFrame, k: int, metric: str, path: str, ext: str) -> None:
    """Write base, queries and exact ground truth as path/base.<ext> (a folder of files with a manifest), path/query.<ext> and
    path/groundtruth.ibin."""
    from ..sources import bigann

    bigann.register(spark)
    column = "words" if ext == "b1bin" else "vector"
    for df, name in ((base, "base"), (queries, "query")):
        df.repartitionByRange("row").sortWithinPartitions("row").write.format("bigann").option("folder", str(name == "base")).mode("append").save(f"{path}/{name}.{ext}")
    ground_truth(base.withColumnRenamed(column, "vector"), queries.withColumnRenamed(column, "vector"), k, metric, path)
