"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_dir, stage

__all__ = ["RunHashes", "crc_mod", "gather_runs", "mix64", "ragged", "read_documents", "shared_dir", "small_batches", "stage", "task_count", "utf8_runs"]

#: Rows of one Arrow batch handed to Python. Documents may hold 100 KB and more, so batches stay small.
ARROW_ROWS = 2048


def read_documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int = 4 << 20) -> None:
    """Bound the Arrow batches by rows and by bytes: a batch of very long texts is cut earlier."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def task_count(spark: SparkSession, total_bytes: int, task_bytes: int = 128 << 20) -> int:
    """Tasks for a shuffle of so many bytes: the session's number, or more when tasks would get more than task_bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // task_bytes))


def crc_mod(column: str, modulus: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser, over an array of uint64."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def ragged(values: list[int] | np.ndarray) -> np.ndarray:
    """Offsets (n + 1) of runs with the given lengths."""
    out = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=out[1:])
    return out


def gather_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1, run after run."""
    offsets = ragged(lengths)
    return np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)


def utf8_runs(texts) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of a batch of texts (a list or an Arrow array; null counts as empty) and their offsets."""
    parts = [x if isinstance(x, bytes) else (x or "").encode("utf-8", "surrogatepass") for x in (texts.to_pylist() if hasattr(texts, "to_pylist") else texts)]
    return b"".join(parts), ragged([len(x) for x in parts])


#: Powers of an odd base modulo 2**64 and of its inverse. Tables are of one block's length, whatever is hashed.
_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 15
_BYTES = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


_UP = _powers(_BASE, _BLOCK + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _BLOCK + 1)[1:]


class RunHashes:
    """64-bit hashes of any runs of a sequence (bytes, or numbers of 64 bits), each in constant time.

    Running Karp-Rabin hashes: `sums` holds the hash of every prefix, made block by block.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for a in range(0, n, _BLOCK):
                part = data[a : a + _BLOCK]
                part = _BYTES[part] if data.dtype == np.uint8 else part.copy()
                m = len(part)
                part *= _DOWN[:m]
                np.cumsum(part, out=part)
                part += self.sums[a]
                np.multiply(part, _UP[1 : m + 1], out=self.sums[a + 1 : a + m + 1])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = ends - starts
        with np.errstate(over="ignore"):
            if int(n.max(initial=0)) <= _BLOCK:
                power = _UP[n]
            else:
                power = _UP[n % _BLOCK] * _powers(pow(_BASE, _BLOCK, 1 << 64), int(n.max()) // _BLOCK + 1)[n // _BLOCK]
            return mix64(self.sums[ends] - self.sums[starts] * power ^ n.astype(np.uint64) << np.uint64(40))
