"""Pattern packing of token sequences by non-negative least squares.

1. A document longer than the capacity is cut into pieces of full capacity; its first piece may be shorter.
2. The pieces' lengths are counted: one row for each length, so `capacity` rows at most reach the driver.
3. `plan` enumerates patterns of few documents that nearly fill a sequence, fits their repeat counts to the histogram
   by non-negative least squares, rounds them down to what the histogram holds, and packs the residual lengths
   best-fit, longest first, again as patterns with repeat counts.
4. A pattern uses up consecutive pieces of each of its lengths. Each piece gets its rank among the pieces of its length
   (rank within its task plus the sums of the tasks before), and the plan gives it its sequence and offset. No group is gathered.

The plan's size depends on the capacity alone. Null texts are empty; an empty document is one piece, its separator.
Equal rows are packed as separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ragged, small_batches, stage
from .encoding import worker_encoder

CAPACITY = 2048
SEPARATOR = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n ids: only the first may be short of the capacity."""
    first = n % capacity or capacity
    return [first, *[capacity] * ((n - first) // capacity)] if n else []


# ---------------------------------------------------------------- plan


def enumerate_patterns(hist: np.ndarray, capacity: int, waste: int = 0, kinds: int = 48) -> np.ndarray:
    """Rows of up to four lengths (0: none) that fill a sequence up to `waste` ids.

    Pairs: every length with every length that completes it. Triples and fours: two or three of `kinds` lengths spread
    evenly over the pieces, and the length that completes them.
    """
    seen = np.flatnonzero(hist)
    out = [np.array([[capacity, 0, 0, 0]])] if hist[capacity] else []
    for w in range(waste + 1):
        mate = capacity - w - seen
        ok = (mate > 0) & (mate <= seen)
        ok[ok] &= hist[mate[ok]] > 0
        out.append(np.stack([seen[ok], mate[ok], 0 * seen[ok], 0 * seen[ok]], axis=1))
    mass = np.cumsum(hist[seen])
    if len(seen):
        some = seen[np.unique(np.searchsorted(mass, np.linspace(1, mass[-1], kinds)))]
        a, b = (x.ravel() for x in np.meshgrid(some, seen, indexing="ij"))
        c = capacity - a - b
        ok = (c > 0) & (a >= b) & (b >= c)
        ok[ok] &= hist[c[ok]] > 0
        out.append(np.stack([a[ok], b[ok], c[ok], 0 * a[ok]], axis=1))
        a, b, c = (x.ravel() for x in np.meshgrid(some, some, some, indexing="ij"))
        d = capacity - a - b - c
        ok = (d > 0) & (a >= b) & (b >= c)
        ok[ok] &= hist[d[ok]] > 0
        out.append(np.stack([a[ok], b[ok], c[ok], d[ok]], axis=1))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 4), dtype=np.int64)


def nnls(patterns: np.ndarray, hist: np.ndarray, steps: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used by the patterns near the histogram (least squares).

    Multiplicative updates x *= A'h / A'Ax, which keep x non-negative and never raise the error.
    """
    target = hist.astype(float).copy()
    target[0] = 0
    used = patterns > 0

    def back(y: np.ndarray) -> np.ndarray:  # A'y
        return np.where(used, y[patterns], 0.0).sum(axis=1)

    aim = back(target)
    x = np.ones(len(patterns)) * (target.sum() / max(1, used.sum()))
    for _ in range(steps):
        made = np.bincount(patterns.ravel(), weights=np.repeat(x, patterns.shape[1]) * used.ravel(), minlength=len(hist))
        x *= aim / np.maximum(back(made), 1e-12)
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Pack the lengths counted in `left` (changed), longest first, each sequence filled by the longest that fit."""
    out = []
    for top in range(capacity, 0, -1):
        while left[top] > 0:
            pattern, room = [top], capacity - top
            need = {top: 1}
            k = room
            while k > 0:
                k = min(k, room)
                while k > 0 and left[k] - need.get(k, 0) <= 0:
                    k -= 1
                if k > 0:
                    pattern.append(k)
                    need[k] = need.get(k, 0) + 1
                    room -= k
            times = min(int(left[k]) // n for k, n in need.items())
            for k, n in need.items():
                left[k] -= times * n
            out.append((pattern, times))
    return out


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """For each length, runs of its pieces: rank of the first, sequence of the first, pieces a sequence, offset.

    The pieces with ranks r, r + 1, ... of one run and slot go to consecutive sequences.
    """
    left = hist.astype(np.int64).copy()
    left[0] = 0
    chosen: list[tuple[list[int], int]] = []
    patterns = enumerate_patterns(left, capacity)
    if len(patterns):
        x = nnls(patterns, left)
        for i in np.argsort(-x, kind="stable"):
            times = int(np.floor(x[i] + 1e-6))
            if not times:
                break
            lengths, per = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
            times = min(times, *(int(left[k]) // int(n) for k, n in zip(lengths, per, strict=True)))
            if times > 0:
                left[lengths] -= times * per
                chosen.append((patterns[i][patterns[i] > 0].tolist(), times))
    chosen += best_fit(left, capacity)
    rank = np.zeros(capacity + 1, dtype=np.int64)
    rows, sequence = [], 0
    for pattern, times in chosen:
        offset = 0
        for k in pattern:
            rows.append((k, rank[k], sequence, offset))
            rank[k] += times
            offset += k
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3], "n_sequences": np.array([sequence])}


# ---------------------------------------------------------------- Spark


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int) -> DataFrame:
    """Pieces of all documents with their digests, and their ranks among the pieces of one length in one task."""
    small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        encoder, task = worker_encoder(vocabulary), TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            ids, lengths = encoder.encode(batch.column(1))
            bounds = ragged(lengths)
            rows: list[tuple] = []
            for name, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own, at = np.append(ids[a:b], np.uint16(SEPARATOR)).astype("<u4"), 0
                for k, n in enumerate(cut_lengths(len(own), capacity)):
                    rows.append((name, k, at, n, zlib.crc32(own[at : at + n].data.cast("B")), task, int(ranks[n])))
                    ranks[n] += 1
                    at += n
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    pieces = stage(pieces_of(docs, vocabulary, capacity))
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        hist[r["length"]] = r["n"]
    tables = plan(hist, capacity)
    before = by_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))

    def place(batches):
        length, rank, sequence, offset = (tables[k] for k in ("length", "rank", "sequence", "offset"))
        key = length << 44 | rank
        for batch in batches:
            own = batch.column("length").to_numpy() << 44 | batch.column("nth").to_numpy()
            k = np.searchsorted(key, own, side="right") - 1
            extra = [pa.array(sequence[k] + batch.column("nth").to_numpy() - rank[k]), pa.array(offset[k])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *extra], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = pieces.join(before, ["length", "task"]).selectExpr("doc_id", "piece", "start", "length", "ids_crc32", "before + rank AS nth")
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
