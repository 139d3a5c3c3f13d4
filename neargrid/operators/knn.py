"""Exact nearest neighbours.

`knn` takes a stated query set against all base rows. Queries go to the tasks in blocks of bounded size, one after another; the
base is read once for each block and never shuffled. Each task keeps k rows a query, so what is shuffled is k rows a query and task;
the last step is a row_number, whose limit Spark applies before and after its shuffle. `knn_join` is the same as a
DataFrame join with the metric as an expression. `knn_grid` takes query sets of any size: both sides are cut into numbered blocks, a
pair of blocks is a cell, and nothing goes through the driver.

Results are ordered by (distance, key); both ways give the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.metrics import metric as find
from ..functions.metrics import pair_distances
from ..sources.staging import stage

#: Bytes of query vectors (as doubles) that go to the tasks at once.
QUERY_BYTES = 64 << 20
#: Queries and base rows whose distances are held at once.
QUERY_TILE, BASE_TILE = 256, 4096
#: Pairs of vectors that are gathered and scored at once.
PAIRS = 1 << 14
#: Dimensions of pairs up to which `knn_join` makes each pair a row.
JOINED = 1 << 28
MISSING_KEY = 4294967295


def check_k(k: int, base_rows: int | None = None, base_dims: int | None = None, query_dims: int | None = None) -> None:
    """k must be in 1..base_rows, and both sides have the same dimensions."""
    if base_dims is not None and query_dims is not None and base_dims != query_dims:
        raise ValueError(f"base vectors have {base_dims} dimensions, queries {query_dims}")
    if k < 1:
        raise ValueError("k must be at least 1")
    if base_rows is not None and k > base_rows:
        raise ValueError(f"k = {k} exceeds the {base_rows} base rows")


def top_k(pairs: DataFrame, k: int, *by: str) -> DataFrame:
    """The k nearest of each query (or of each `by`), with rank from 1."""
    w = Window.partitionBy(*(by or ("query_id",))).orderBy("distance", "key")
    return pairs.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


class Scan:
    """The k nearest of what went by, for a block of queries. Tiles of both sides have fixed sizes."""

    def __init__(self, queries: np.ndarray, k: int, name: str):
        self.metric, self.queries, self.k = find(name), queries, k
        self.key = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.dist = np.full((len(queries), k), np.inf)

    def add(self, keys: np.ndarray, vectors: np.ndarray) -> None:
        for a in range(0, len(keys), BASE_TILE):
            names, own = keys[a : a + BASE_TILE], vectors[a : a + BASE_TILE]
            for c in range(0, len(self.queries), QUERY_TILE):
                look = self._shortlist if self.metric.quick else self._bounded if self.metric.least else self._scan
                look(c, self.queries[c : c + QUERY_TILE], names, own)

    def _scan(self, c: int, asked: np.ndarray, names: np.ndarray, own: np.ndarray) -> None:
        """Every distance, in the order of terms."""
        exact = self.metric.block(asked, own)
        rows, cols = np.nonzero(exact <= self._bar(c, exact)[:, None])
        self._merge(c, rows, names[cols], exact[rows, cols])

    def _shortlist(self, c: int, asked: np.ndarray, names: np.ndarray, own: np.ndarray) -> None:
        """A matrix product proposes whatever may come before the k-th so far; the exact order of terms decides."""
        quick = self.metric.quick(asked, own)
        scale = np.abs(quick).max(initial=1.0) + np.abs(own).max(initial=1.0) ** 2 * own.shape[1]
        rows, cols = np.nonzero(quick <= self._bar(c, quick)[:, None] + 1e-11 * scale)
        for a in range(0, len(rows), PAIRS):
            r, of = rows[a : a + PAIRS], cols[a : a + PAIRS]
            self._merge(c, r, names[of], self.metric.pairs(asked[r], own[of]))

    def _bounded(self, c: int, asked: np.ndarray, names: np.ndarray, own: np.ndarray) -> None:
        """Rows whose lower bound comes before the k-th so far are scored; without k so far, the k with the least bounds are, first."""
        least, closer = self.metric.least(asked, own), self.metric.closer and self.metric.closer(asked, own)
        if least.shape[1] > 2 * self.k and np.isinf(self.dist[c : c + len(asked), -1]).any():
            cols = np.argpartition(least, self.k - 1, axis=1)[:, : self.k].ravel()
            rows = np.repeat(np.arange(len(asked)), self.k)
            self._merge(c, rows, names[cols], self.metric.pairs(asked[rows], own[cols]))
            least[rows, cols] = np.inf
        rows, cols = np.nonzero(least <= self.dist[c : c + len(asked), -1:])
        for a in range(0, len(rows), PAIRS):  # in parts, as many may pass a bound that is not tight
            r, of = rows[a : a + PAIRS], cols[a : a + PAIRS]
            if closer:
                on = closer(r, of) <= self.dist[c + r, -1]
                r, of = r[on], of[on]
            self._merge(c, r, names[of], self.metric.pairs(asked[r], own[of]))

    def _bar(self, c: int, distances: np.ndarray) -> np.ndarray:
        """For each query a bound on its k-th distance, from what went by and from this tile."""
        bar = self.dist[c : c + len(distances), -1]
        if distances.shape[1] > self.k and np.isinf(bar).any():
            bar = np.minimum(bar, np.partition(distances, self.k - 1, axis=1)[:, self.k - 1])
        return bar

    def _merge(self, c: int, rows: np.ndarray, keys: np.ndarray, distances: np.ndarray) -> None:
        """Keep the k least (distance, key) of each query that got new rows."""
        on = np.unique(rows)
        if not len(on):
            return
        row = np.concatenate([np.repeat(on, self.k), rows])
        dist, key = np.concatenate([self.dist[c + on].ravel(), distances]), np.concatenate([self.key[c + on].ravel(), keys])
        order = np.lexsort((key, dist, row))
        first = np.searchsorted(row[order], on)
        keep = order[first[:, None] + np.arange(self.k)]
        self.dist[c + on], self.key[c + on] = dist[keep], key[keep]


def matrix(column: pa.Array, bits: bool) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.int64 if bits else np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def query_blocks(queries: DataFrame, query_bytes: int):
    """The number of blocks of at most about query_bytes, and a generator of the blocks' queries (Arrow tables): the
    driver holds one block at a time."""
    sizes = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    blocks = max(1, -(-sizes["n"] * max(1, sizes["d"] or 1) * 8 * 2 // query_bytes)) if sizes["n"] * (sizes["d"] or 1) * 8 > query_bytes else 1
    one = lambda b: queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
    return blocks, (one(b).toArrow() for b in range(blocks))


def knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", by: str | None = None, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, key, distance. base: key, vector; queries: query_id, vector. With `by`, k rows for each value of
    that base column as well (shards, epochs)."""
    check_k(k)
    bits = find(metric).bits
    out = None
    n_blocks, blocks = query_blocks(queries, query_bytes)
    for rows in blocks:
        if not rows.num_rows:
            continue
        names, vectors = rows.column("query_id").to_numpy().astype(np.int64), matrix(rows.column("vector").combine_chunks(), bits)

        def run(batches, names=names, vectors=vectors):
            scans: dict[int, Scan] = {}
            for batch in batches:
                keys, block = batch.column(0).to_numpy(), matrix(batch.column(1), bits)
                group = batch.column(2).to_numpy()
                for g in np.unique(group):
                    on = group == g
                    scans.setdefault(int(g), Scan(vectors, k, metric)).add(keys[on], block[on])
            for g, s in scans.items():
                n = s.key.shape[1]
                found = np.isfinite(s.dist).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(found.sum(), g)), pa.array(np.repeat(names, n)[found]), pa.array(s.key.ravel()[found]), pa.array(s.dist.ravel()[found])], names=["grp", "query_id", "key", "distance"])

        columns = base.select(F.col("key").cast("long"), "vector", (F.col(by) if by else F.lit(0)).cast("long").alias("grp"))
        part = top_k(columns.mapInArrow(run, "grp long, query_id long, key long, distance double"), k, "grp", "query_id")
        if n_blocks > 1:  # k rows a query are written, so that no plan holds on to the block
            part = stage(part)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = base.sparkSession.createDataFrame([], "grp long, query_id long, key long, distance double, rank long")
    return out.select(F.col("grp").alias(by), "query_id", "rank", "key", "distance") if by else out.select("query_id", "rank", "key", "distance")


def radius_count(base: DataFrame, queries: DataFrame, radius: float, metric: str = "l2", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, within: how many base rows lie within a distance of each query. One scan of the base for each block of
    queries, one row a query from each task; distances near the radius are added up term by term."""
    kind = find(metric)
    out = queries.select(F.col("query_id").cast("long").alias("query_id"), F.lit(0).cast("long").alias("within"))  # queries without any
    for rows in query_blocks(queries, query_bytes)[1]:
        if not rows.num_rows:
            continue
        names, vectors = rows.column("query_id").to_numpy().astype(np.int64), matrix(rows.column("vector").combine_chunks(), kind.bits)

        def run(batches, names=names, vectors=vectors):
            n = np.zeros(len(names), dtype=np.int64)
            for batch in batches:
                own = matrix(batch.column(0), kind.bits)
                for a in range(0, len(own), BASE_TILE):
                    some = own[a : a + BASE_TILE]
                    for c in range(0, len(vectors), QUERY_TILE):
                        asked = vectors[c : c + QUERY_TILE]
                        if kind.quick is None:
                            n[c : c + len(asked)] += (kind.block(asked, some) <= radius).sum(axis=1)
                            continue
                        quick = kind.quick(asked, some)
                        slack = 1e-11 * (np.abs(quick).max(initial=1.0) + np.abs(some).max(initial=1.0) ** 2 * some.shape[1])
                        row, col = np.nonzero(np.abs(quick - radius) <= slack)
                        near = kind.pairs(asked[row], some[col]) <= radius
                        n[c : c + len(asked)] += (quick < radius - slack).sum(axis=1) + np.bincount(row[near], minlength=len(asked))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n)], names=["query_id", "within"])

        out = out.unionByName(base.select("vector").mapInArrow(run, "query_id long, within long"))
    return out.groupBy("query_id").agg(F.sum("within").alias("within"))


def knn_join(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """The same rows by a nested-loop join over a broadcast query set of checked size, all inside the JVM, where the pairs are
    so few that an expression for each is no more work than tiles of them; `knn` beyond."""
    check_k(k)
    sizes = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    each = sizes["n"] * (sizes["d"] or 1)
    if each * 8 > QUERY_BYTES or each * base.count() > JOINED:
        return knn(base, queries, k, metric)
    pairs = base.crossJoin(F.broadcast(queries.withColumnRenamed("vector", "query"))).select("query_id", "key", find(metric).column(F.col("query"), F.col("vector")).alias("distance"))
    return top_k(pairs, k).select("query_id", "rank", "key", "distance")


def knn_grid(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", cell_rows: int = 8192) -> DataFrame:
    """query_id, rank, key, distance, as by `knn`, for any number of queries (ids and keys are distinct).

    Rows are dealt by hash into blocks of about cell_rows, each block is sent to the cells of its row or column of the grid,
    and a task holds one cell. A cell keeps k rows a query; the rest is a row_number, limited before its shuffle.
    """
    check_k(k)
    bits = find(metric).bits
    n_base, n_queries = (max(1, -(-df.count() // cell_rows)) for df in (base, queries))
    deal = lambda column, own, others: (F.pmod(F.xxhash64(column), F.lit(own)), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(others - 1).cast("bigint"))))
    q_own, q_other = deal("query_id", n_queries, n_base)
    b_own, b_other = deal("key", n_base, n_queries)
    left = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").alias("vector"), q_own.alias("across"), q_other.alias("down"))
    right = base.select(F.col("key").cast("long").alias("key"), F.col("vector").alias("vector"), b_own.alias("down"), b_other.alias("across"))

    def compare(cell: tuple, asked: pa.Table, rows: pa.Table) -> pa.Table:
        out = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]
        if asked.num_rows and rows.num_rows:
            best = Scan(matrix(asked.column("vector").combine_chunks(), bits), k, metric)
            best.add(rows.column("key").to_numpy(), matrix(rows.column("vector").combine_chunks(), bits))
            found = np.isfinite(best.dist)
            out = [np.repeat(asked.column("query_id").to_numpy(), found.sum(axis=1)), best.key[found], best.dist[found]]
        return pa.table([pa.array(c) for c in out], names=["query_id", "key", "distance"])

    cells = left.groupBy("across", "down").cogroup(right.groupBy("across", "down")).applyInArrow(compare, "query_id long, key long, distance double")
    return top_k(cells, k).select("query_id", "rank", "key", "distance")


def merge_shards(results: DataFrame, k: int) -> DataFrame:
    """k nearest over all shards; on equal distances the earlier shard comes first. results: shard, query_id, rank, key, distance."""
    w = Window.partitionBy("query_id").orderBy("distance", "shard", "rank")
    return results.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k).select("query_id", "rank", "key", "distance")


def padded(results: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """k rows for each query; unfilled ones hold the missing key at an infinite distance."""
    slots = queries.select("query_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(k).cast("bigint"))).alias("rank"))
    return slots.join(results, ["query_id", "rank"], "left").select("query_id", "rank", F.coalesce("key", F.lit(MISSING_KEY)).alias("key"), F.coalesce("distance", F.lit(float("inf"))).alias("distance"))


def translate_labels(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Internal labels to user keys (label, user_key); unknown labels give the missing key at an infinite distance."""
    joined = results.join(labels, results["key"] == labels["label"], "left")
    known = F.col("user_key").isNotNull()
    return joined.select("query_id", "rank", F.coalesce("user_key", F.lit(MISSING_KEY)).alias("key"), F.when(known, F.col("distance")).otherwise(F.lit(float("inf"))).alias("distance"))


def fetched(candidates: DataFrame, base: DataFrame) -> DataFrame:
    """(query_id, key) candidates with their base rows. Few candidates go to the base, so that its rows stay where they are; beyond
    QUERY_BYTES both sides meet by a shuffle. candidates: read twice, so a stored table."""
    if candidates.count() * 16 <= QUERY_BYTES:
        candidates = F.broadcast(candidates)
    return base.join(candidates, "key")


def scored(pairs: DataFrame, metric: str) -> DataFrame:
    """query_id, key, distance of pairs of vectors (query, vector), by numpy."""
    kind = find(metric)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = matrix(batch.column(2), kind.bits), matrix(batch.column(3), kind.bits)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pair_distances(metric, x, y))], names=["query_id", "key", "distance"])

    return pairs.select(F.col("query_id").cast("long"), F.col("key").cast("long"), "query", "vector").mapInArrow(run, "query_id long, key long, distance double")


def rerank(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Exact distances for (query_id, key) candidates, then the k nearest."""
    pairs = fetched(stage(candidates.select("query_id", "key")), base).join(queries.withColumnRenamed("vector", "query"), "query_id")
    if find(metric).pairs:
        return top_k(scored(pairs, metric), k).select("query_id", "rank", "key", "distance")
    return top_k(pairs.select("query_id", "key", find(metric).column(F.col("query"), F.col("vector")).alias("distance")), k).select("query_id", "rank", "key", "distance")
