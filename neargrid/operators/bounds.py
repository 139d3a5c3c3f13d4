"""Exact search by one-byte codes, with vectors fetched only for rows that bounds cannot rule out.

A row is kept as a code of one byte a dimension, the length of what the code misses (its residual), and its own length.
With c the decoded vector and e the residual's length, the triangle inequality bounds the distance of a query q from
the row on both sides: |q - c| - e <= |q - x| <= |q - c| + e, and for products |q.x - q.c| <= |q| e. A scan of the codes, a quarter
of the bytes of floats, gives each query an upper bound on its k-th distance; rows whose lower bound is beyond it are
out for certain. The others' vectors are fetched and scored term by term, so results are those of `knn`, ties included.

Codes are clamped to the range of what was there at the first `add`: later rows beyond it have longer residuals and
looser bounds, and results stay exact. Where codes tell nothing (all rows alike but for less than a code's step) all rows survive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import metric as find
from ..functions.quantize import dim_bounds
from ..sources.staging import stage
from .graph import save_meta
from .knn import BASE_TILE, QUERY_BYTES, QUERY_TILE, check_k, fetched, matrix, query_blocks, top_k

METRICS = ("l2", "ip", "cos")
LEVELS = 256
#: Candidates that a task holds before it passes them on.
POOL = 1 << 18
#: Relative slack of bounds for rounding in sums of up to some 10,000 terms.
SLACK = 1e-11
CODES = "key long, code binary, residual double, length double"


def encode(base: DataFrame, low: np.ndarray, step: np.ndarray) -> DataFrame:
    """key, code, residual, length of each row, for cells of width step from low in each dimension."""

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), False)
            code = np.zeros(x.shape, dtype=np.uint8)
            if len(x):
                code = np.clip(np.floor((x - low) / np.where(step > 0, step, 1.0)), 0, LEVELS - 1).astype(np.uint8)
            missed = np.linalg.norm(x - decode(code, low, step), axis=1) * (1 + SLACK)
            flat = pa.py_buffer(code.tobytes())
            ends = pa.py_buffer((np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]).tobytes())
            codes = pa.Array.from_buffers(pa.binary(), len(x), [None, ends, flat])
            yield pa.RecordBatch.from_arrays([batch.column(0), codes, pa.array(missed), pa.array(np.linalg.norm(x, axis=1))], names=["key", "code", "residual", "length"])

    return base.select(F.col("key").cast("long"), "vector").mapInArrow(run, CODES)


def decode(code: np.ndarray, low: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The middles of the cells."""
    return low + (code + 0.5) * step if code.size else np.zeros(code.shape)


def distance_bounds(name: str, asked: np.ndarray, middle: np.ndarray, residual: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query and row a distance that the row is not nearer than, and one that it is not farther than."""
    own, product = np.linalg.norm(asked, axis=1), asked @ middle.T
    if name == "l2":
        sizes = (own * own)[:, None] + (middle * middle).sum(axis=1)[None, :]
        squared, error = sizes - 2 * product, SLACK * sizes
        near = np.maximum(np.sqrt(np.maximum(squared - error, 0)) - residual, 0)
        far = np.sqrt(np.maximum(squared, 0) + error) + residual
        return near * near * (1 - SLACK), far * far * (1 + SLACK)
    scale = own[:, None] * (length + residual)[None, :]
    wide = own[:, None] * residual[None, :] + SLACK * scale
    if name == "ip":
        return 1 - product - wide - SLACK, 1 - product + wide + SLACK
    whole = own[:, None] * length[None, :]
    some = np.where(whole > 0, whole, 1.0)
    # the distance of a vector of length zero is 1
    low, high = (np.where(whole > 0, 1 - (product + side) / some, 1.0) for side in (wide, -wide))
    return low - SLACK, high + SLACK


class Sieve:
    """Rows that may be among the k nearest of a block of queries, by what went by."""

    def __init__(self, queries: np.ndarray, k: int, name: str):
        self.queries, self.k, self.name = queries, k, name
        self.upper = np.full((len(queries), k), np.inf)  # the k least upper bounds
        self.pool: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, middle: np.ndarray, residual: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """What has to be passed on so that not more than POOL candidates and those of a tile are held."""
        for a in range(0, len(keys), BASE_TILE):
            of = slice(a, a + BASE_TILE)
            for c in range(0, len(self.queries), QUERY_TILE):
                low, high = distance_bounds(self.name, self.queries[c : c + QUERY_TILE], middle[of], residual[of], length[of])
                bar = self.upper[c : c + len(low)]
                least = np.partition(high, self.k - 1, axis=1)[:, : self.k] if high.shape[1] > self.k else high
                bar[:] = np.partition(np.concatenate([bar, least], axis=1), self.k - 1, axis=1)[:, : self.k]
                rows, cols = np.nonzero(low <= bar.max(axis=1)[:, None])
                self.pool.append((rows + c, keys[of][cols], low[rows, cols], high[rows, cols]))
                self.held += len(rows)
                if self.held > POOL:
                    yield self.drain()

    def drain(self) -> tuple[np.ndarray, ...]:
        """What is held and still may be near; nothing is held afterwards."""
        row, key, low, high = (np.concatenate(c) for c in zip(*self.pool, strict=True)) if self.pool else (np.zeros(0, dtype=np.int64),) * 4
        keep = low <= self.upper.max(axis=1)[row]
        self.pool, self.held = [], 0
        return row[keep], key[keep], low[keep], high[keep]


def survivors(codes: DataFrame, queries: DataFrame, k: int, name: str, low: np.ndarray, step: np.ndarray, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, key of all rows that bounds do not rule out; written, as it is read more than once."""
    out = None
    _, blocks = query_blocks(queries, query_bytes)
    for rows in blocks:
        if not rows.num_rows:
            continue
        names, vectors = rows.column("query_id").to_numpy().astype(np.int64), matrix(rows.column("vector").combine_chunks(), False)

        def run(batches, names=names, vectors=vectors):
            sieve = Sieve(vectors, k, name)

            def passed(row, key, near, far):
                return pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(key.astype(np.int64)), pa.array(near.astype(float)), pa.array(far.astype(float))], names=["query_id", "key", "low", "high"])

            for batch in batches:
                if not batch.num_rows:
                    continue
                code = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)
                for some in sieve.add(batch.column(0).to_numpy(), decode(code, low, step), batch.column(2).to_numpy(), batch.column(3).to_numpy()):
                    yield passed(*some)
            yield passed(*sieve.drain())

        near = stage(codes.mapInArrow(run, "query_id long, key long, low double, high double"))
        # each task has passed on its k least upper bounds, so the k least of all are among them
        bars = top_k(near.select("query_id", "key", F.col("high").alias("distance")), k).groupBy("query_id").agg(F.max("distance").alias("bar"), F.count("*").alias("n"))
        part = stage(near.join(bars, "query_id").where((F.col("low") <= F.col("bar")) | (F.col("n") < k)).select("query_id", "key"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else codes.sparkSession.createDataFrame([], "query_id long, key long")


@dataclass
class BoundsIndex:
    """Exact search (l2, ip, cos) by codes with bounds. `fetches` gives how many vectors the last search has fetched for each query."""

    metric: str = "l2"
    base: DataFrame | None = field(default=None, repr=False)
    codes: DataFrame | None = field(default=None, repr=False)
    low: list[float] | None = field(default=None, repr=False)
    step: list[float] | None = field(default=None, repr=False)
    fetches: DataFrame | None = field(default=None, repr=False)

    def __post_init__(self):
        if self.metric not in METRICS:
            raise ValueError(f"bounds are known for {', '.join(METRICS)}, not {self.metric!r}")

    def _cells(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.low, dtype=np.float64), np.array(self.step, dtype=np.float64)

    def add(self, base: DataFrame) -> None:
        base = stage(base.select(F.col("key").cast("long").alias("key"), "vector"))
        if not self.low:  # one row a dimension
            rows = dim_bounds(base, "vector").orderBy("dim").collect()
            self.low, self.step = [r["low"] for r in rows], [(r["high"] - r["low"]) / LEVELS for r in rows]
        codes = stage(encode(base, *self._cells()))
        self.base = base if self.base is None else self.base.unionByName(base)
        self.codes = codes if self.codes is None else self.codes.unionByName(codes)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        check_k(k)
        pairs = survivors(self.codes, queries, k, self.metric, *self._cells())
        self.fetches = pairs.groupBy("query_id").agg(F.count("*").alias("fetched"))
        both = fetched(pairs, self.base).join(queries.select("query_id", F.col("vector").alias("query")), "query_id")
        scored = both.select("query_id", "key", find(self.metric).column(F.col("query"), F.col("vector")).alias("distance"))
        return top_k(scored, k).select("query_id", "rank", "key", "distance")

    def save(self, path: str) -> None:
        self.base.write.parquet(f"{path}/rows")
        self.codes.write.parquet(f"{path}/codes")
        save_meta(self.base.sparkSession, path, {"kind": "bounds", "metric": self.metric, "low": self.low, "step": self.step})

    @classmethod
    def loaded(cls, spark: SparkSession, path: str, meta: dict) -> BoundsIndex:
        return cls(base=spark.read.parquet(f"{path}/rows"), codes=spark.read.parquet(f"{path}/codes"), **meta)

    def size_bytes(self) -> int:
        """Bytes of the codes; vectors are not held but fetched."""
        return self.codes.agg(F.sum(F.length("code") + 24).alias("n")).first()["n"] or 0
