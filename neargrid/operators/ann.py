"""Index backends, and approximate neighbours by sign-projection buckets (`graph` has those by neighbour graphs).

All are VectorIndex backends: `add` materialises (so building is not billed to the first search, and survives lost
executors), `search` returns query_id, rank, key, distance, `save` and `load` go through Parquet.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import stage
from .bounds import BoundsIndex
from .graph import GraphIndex, asdict_simple, save_meta
from .knn import knn, matrix, rerank


class VectorIndex(Protocol):
    def add(self, base: DataFrame) -> None: ...
    def search(self, queries: DataFrame, k: int) -> DataFrame: ...
    def save(self, path: str) -> None: ...
    def size_bytes(self) -> int: ...


@dataclass
class FlatIndex:
    """Exact search over what was added."""

    metric: str = "l2"
    base: DataFrame | None = field(default=None, repr=False)

    def add(self, base: DataFrame) -> None:
        base = stage(base.select("key", "vector"))
        self.base = base if self.base is None else self.base.unionByName(base)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return knn(self.base, queries, k, self.metric)

    def save(self, path: str) -> None:
        self.base.write.parquet(f"{path}/rows")
        save_meta(self.base.sparkSession, path, {"kind": "flat", "metric": self.metric})

    def size_bytes(self) -> int:
        d = self.base.agg(F.sum(F.size("vector") * 4 + 8).alias("n")).first()["n"]
        return d or 0


def memory_bytes(dims, connectivity: int, scalar_bytes: int = 4):
    """Estimated memory of a row in a graph index: its vector, its key and two links of four bytes for each neighbour."""
    return dims.cast("bigint") * scalar_bytes + 8 + 2 * connectivity * 4


@dataclass
class SignLsh:
    """Random hyperplanes: vectors that fall on the same side of `bits` planes share a bucket in one of `tables` tables.

    bits = 0: chosen by the first `add`, so that a bucket holds some `bucket_rows` rows whatever their number. A query looks
    into its own bucket and those `probes` that differ in the planes it lies nearest to. Buckets only propose; each
    task counts a candidate once and keeps what its query shares most tables with (`candidates` a query), which are scored
    exactly. Rows of a bucket are salted over `salts` tasks.
    """

    dims: int
    metric: str = "cos"
    tables: int = 24
    bits: int = 0
    bucket_rows: int = 32
    probes: int = 4
    candidates: int = 1000
    salts: int = 4
    seed: int = 42
    entries: DataFrame | None = field(default=None, repr=False)
    base: DataFrame | None = field(default=None, repr=False)

    def _buckets(self, df: DataFrame, name: str, probes: int = 0) -> DataFrame:
        planes = np.random.default_rng(self.seed).standard_normal((self.tables, self.bits, self.dims))
        weights, tables, bits = 1 << np.arange(self.bits), self.tables, self.bits
        probes = min(probes, bits)

        def run(batches):
            for batch in batches:
                side = np.einsum("tbd,nd->ntb", planes, matrix(batch.column(1), False))
                own = ((side > 0) * weights).sum(axis=2)
                near = weights[np.argsort(np.abs(side), axis=2)[:, :, :probes]]
                codes = np.concatenate([own[:, :, None], own[:, :, None] ^ near], axis=2) + (np.arange(tables) << bits)[None, :, None]
                names = np.repeat(batch.column(0).to_numpy(), tables * (1 + probes))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(codes.ravel().astype(np.int64))], names=[name, "bucket"])

        return df.select(F.col(name).cast("long"), "vector").mapInArrow(run, f"{name} long, bucket long")

    def add(self, base: DataFrame) -> None:
        base = stage(base.select("key", "vector"))
        if not self.bits:
            self.bits = int(np.clip(np.ceil(np.log2(max(1, base.count()) / self.bucket_rows)), 3, 40))
        entries = stage(self._buckets(base, "key").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(self.salts))))
        self.base = base if self.base is None else self.base.unionByName(base)
        self.entries = entries if self.entries is None else self.entries.unionByName(entries)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        asked = self._buckets(queries, "query_id", self.probes).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(self.salts - 1).cast("bigint"))))
        pairs = asked.join(self.entries, ["bucket", "salt"]).groupBy("query_id", "key").agg(F.count("*").alias("n"))
        w = Window.partitionBy("query_id").orderBy(F.desc("n"), "key")
        some = pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(self.candidates, k))
        return rerank(some.select("query_id", "key"), self.base, queries, k, self.metric)

    def save(self, path: str) -> None:
        self.base.write.parquet(f"{path}/rows")
        self.entries.write.parquet(f"{path}/entries")
        save_meta(self.base.sparkSession, path, {"kind": "lsh", **{k: v for k, v in asdict_simple(self).items()}})

    def size_bytes(self) -> int:
        return self.base.count() * (self.dims * 4 + 8 + 24 * self.tables)


def load(spark: SparkSession, path: str) -> VectorIndex:
    """An index saved by one of the backends."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    kind = meta.pop("kind")
    if kind == "graph":
        return GraphIndex.loaded(spark, path, meta)
    if kind == "bounds":
        return BoundsIndex.loaded(spark, path, meta)
    rows = spark.read.parquet(f"{path}/rows")
    if kind == "flat":
        return FlatIndex(meta["metric"], rows)
    return SignLsh(**meta, entries=spark.read.parquet(f"{path}/entries"), base=rows)
