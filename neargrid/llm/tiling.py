"""Benchmark decontamination by greedy string tiling.

Words of a document and of a benchmark item that share a seed (a run of `seed` words) are tiled: the longest common runs
of words not yet marked are found by running Karp-Rabin hashes, checked word by word, and marked on both sides, longest
first, until none of `seed` words is left. An item leaks if the tiles cover at least `threshold` of its words: passages
that were cut apart and put in another order count as well.

The benchmark is a stated query set: it goes to the tasks in blocks of at most `block_bytes` of text, and every block
meets all documents. Seeds shared with an item bound its coverage from above, so pairs below the threshold need no tiling.

Null and empty texts never leak; an item of fewer words than a seed is its own seed; an item without words never leaks.
Repeated rows give repeated results; equal item texts each give a row. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .words import Words, window_hashes

SEED = 5
THRESHOLD = 0.6
BLOCK_BYTES = 8 << 20
HITS = "doc_id long, item_id long, coverage double, matched_words int, item_words int, n_tiles int"


def common_runs(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, s: int) -> list[tuple[int, int, int]]:
    """Maximal common runs (length, place in a, place in b) of at least s unmarked words."""

    def windows(x: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = window_hashes(x, s)
        if not len(h):
            return h, np.zeros(0, dtype=np.int64)
        sums = np.concatenate([[0], np.cumsum(free)])
        at = np.flatnonzero(sums[s:] - sums[:-s] == s)
        return h[at], at

    hb, at_b = windows(b, free_b)
    where: dict[int, list[int]] = {}
    for h, j in zip(hb.tolist(), at_b.tolist(), strict=True):
        where.setdefault(h, []).append(j)
    ha, at_a = windows(a, free_a)
    found, seen = [], set()
    for h, i in zip(ha.tolist(), at_a.tolist(), strict=True):
        for j in where.get(h, ()):
            if (i - 1, j - 1) in seen:  # inside a longer run
                seen.add((i, j))
                continue
            if not np.array_equal(a[i : i + s], b[j : j + s]):
                continue
            n = s
            while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                n += 1
            seen.add((i, j))
            found.append((n, i, j))
    return found


def greedy_tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (length, place in a, place in b), longest first, none overlapping another on either side."""
    free_a, free_b = np.ones(len(a), dtype=bool), np.ones(len(b), dtype=bool)
    tiles: list[tuple[int, int, int]] = []
    s = max(least, min(len(b), 4 * least))
    while True:
        found = common_runs(a, b, free_a, free_b, s)
        longest = max((n for n, _, _ in found), default=0)
        if longest > 2 * s:
            s = longest
            continue
        again = False
        for n, i, j in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if free_a[i : i + n].all() and free_b[j : j + n].all():
                tiles.append((n, i, j))
                free_a[i : i + n] = free_b[j : j + n] = False
            else:
                again = True  # what is left of it may still be long enough
        if again:
            continue
        if s == least:
            return tiles
        s = max(least, s // 2)


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], seed: int):
        words = Words([t for _, t in items])
        self.seed, self.items, entries = seed, [], []
        for k, (name, _) in enumerate(items):
            own = words.hashes[words.bounds[k] : words.bounds[k + 1]]
            if len(own):
                entries += [(h, len(self.items), j) for j, h in enumerate(window_hashes(own, min(seed, len(own))).tolist())]
                self.items.append((name, own))
        self.short = sorted({len(x) for _, x in self.items if len(x) < seed})
        table = sorted(entries)
        self.seeds = np.array([e[0] for e in table], dtype=np.uint64)
        self.of = np.array([e[1] for e in table], dtype=np.int64)
        self.place = np.array([e[2] for e in table], dtype=np.int64)
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.seeds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def shared(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of seeds of k words that occur in items, and the range of table entries of each."""
        h = window_hashes(words, k)
        at = np.flatnonzero(self.filter[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        lo, hi = np.searchsorted(self.seeds, h[at], "left"), np.searchsorted(self.seeds, h[at], "right")
        return at[hi > lo], lo[hi > lo], hi[hi > lo]

    def hits(self, words: Words, threshold: float):
        """(text number, item number, tiles) for each pair that reaches the threshold."""
        near: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for k in [*self.short, self.seed]:
            at, lo, hi = self.shared(words.hashes, k)
            doc = np.searchsorted(words.bounds, at, side="right") - 1
            inside = at + k <= words.bounds[doc + 1]
            for i, d, a, b in zip(at[inside].tolist(), doc[inside].tolist(), lo[inside].tolist(), hi[inside].tolist(), strict=True):
                for e in range(a, b):
                    item = int(self.of[e])
                    if min(self.seed, len(self.items[item][1])) == k:
                        near.setdefault((d, item), []).append((i, int(self.place[e]), k))
        for (d, item), seeds in sorted(near.items()):
            own = self.items[item][1]
            covered = np.zeros(len(own), dtype=bool)
            for _, j, k in seeds:
                covered[j : j + k] = True
            if covered.sum() < threshold * len(own):
                continue
            # only words near a seed can be part of a tile
            keep = np.zeros(words.bounds[d + 1] - words.bounds[d] + 1, dtype=np.int64)
            for i, _, k in seeds:
                keep[i - words.bounds[d]] += 1
                keep[min(i - words.bounds[d] + k, len(keep) - 1)] -= 1
            on = np.cumsum(keep[:-1]) > 0
            text = np.where(on, words.hashes[words.bounds[d] : words.bounds[d + 1]], np.uint64(0))
            edges = np.flatnonzero(on | np.concatenate([[False], on[:-1]]))
            tiles = greedy_tiles(text[edges], own, min(self.seed, len(own)))
            if sum(n for n, _, _ in tiles) >= threshold * len(own):
                yield d, item, tiles


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed: int = SEED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and benchmark item that leaks into it."""
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes))
    out = None
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = [(r["item_id"], r["text"]) for r in block.collect()]  # about half of block_bytes

        def run(batches, rows=rows):
            index = Index(rows, seed)
            for batch in batches:
                words = Words(batch.column(1))
                names, found = batch.column(0).to_pylist(), []
                for d, item, tiles in index.hits(words, threshold):
                    name, own = index.items[item]
                    covered = sum(x[0] for x in tiles)
                    found.append((names[d], name, covered / len(own), covered, len(own), len(tiles)))
                columns = list(zip(*found, strict=True)) if found else [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in HITS.split(", ")])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, HITS)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents into which no item leaks."""
    bad = leaks(docs, benchmark, **options).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad"]), "left_anti").select(*docs.columns)
