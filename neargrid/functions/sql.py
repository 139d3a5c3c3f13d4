"""The library from SQL: metrics and vector expressions as SQL functions, and exact neighbours as a table function.

SQL functions are expressions that Catalyst inlines, so they run inside the JVM and add terms in the order of `metrics`. The
table function takes cells of a grid (a block of queries and a block of base rows):

    SELECT * FROM nearest(10, 'l2', TABLE(cells) PARTITION BY (across, down) ORDER BY side)

`cells` has the columns side (0: query, 1: base row), id and vector. Queries of a cell come first and are held, its base rows
stream by. `nearest_sql` writes the whole statement over two views, with the cells and the merge of their results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from .metrics import metric


def _sum(term: str, x: str = "x", y: str = "y") -> str:
    return f"aggregate(zip_with({x}, {y}, (a, b) -> {term}), 0D, (s, v) -> s + v)"


def _own(x: str, term: str = "a * a") -> str:
    return f"aggregate(transform({x}, a -> {term}), 0D, (s, v) -> s + v)"


def _bits(term: str) -> str:
    return f"aggregate(zip_with(x, y, (a, b) -> CAST({term} AS BIGINT)), 0L, (s, v) -> s + v)"


def _variance(x: str) -> str:
    return f"greatest(size(x) * {_own(x)} - {_own(x, 'a')} * {_own(x, 'a')}, 0D)"


_NORM = f"sqrt({_own('x')} * {_own('y')})"
_SPREAD = f"sqrt({_variance('x')} * {_variance('y')})"
_HALF = "CASE WHEN a > 0 THEN a * ln(CASE WHEN a > 0 THEN 2 * a / (a + b) ELSE 1D END) ELSE 0D END"
_ARC = "pow(sin((y[0] - x[0]) / 2), 2) + cos(x[0]) * cos(y[0]) * pow(sin((y[1] - x[1]) / 2), 2)"

#: name: (type of x and y, expression). Names are those of the metrics with _distance.
DISTANCES = {
    "l2": ("ARRAY<DOUBLE>", _sum("(a - b) * (a - b)")),
    "ip": ("ARRAY<DOUBLE>", f"1D - {_sum('a * b')}"),
    "cos": ("ARRAY<DOUBLE>", f"CASE WHEN {_NORM} = 0 THEN 1D ELSE 1D - {_sum('a * b')} / {_NORM} END"),
    "manhattan": ("ARRAY<DOUBLE>", _sum("abs(a - b)")),
    "pearson": ("ARRAY<DOUBLE>", f"CASE WHEN {_SPREAD} = 0 THEN 1D ELSE 1D - (size(x) * {_sum('a * b')} - {_own('x', 'a')} * {_own('y', 'a')}) / {_SPREAD} END"),
    "haversine": ("ARRAY<DOUBLE>", f"2D * asin(least(1D, sqrt({_ARC})))"),
    "divergence": ("ARRAY<DOUBLE>", f"0.5D * {_sum(_HALF)} + 0.5D * {_sum(_HALF, 'y', 'x')}"),
    "hamming": ("ARRAY<BIGINT>", f"CAST({_bits('bit_count(a ^ b)')} AS DOUBLE)"),
    "jaccard": ("ARRAY<BIGINT>", f"CASE WHEN {_bits('bit_count(a | b)')} = 0 THEN 0D ELSE 1D - {_bits('bit_count(a & b)')} / {_bits('bit_count(a | b)')} END"),
    "sorensen": ("ARRAY<BIGINT>", f"CASE WHEN {_bits('bit_count(a) + bit_count(b)')} = 0 THEN 0D ELSE 1D - 2 * {_bits('bit_count(a & b)')} / {_bits('bit_count(a) + bit_count(b)')} END"),
}
#: name: (parameters, result, expression)
OTHERS = {
    "vector_i8": ("x ARRAY<DOUBLE>, scale DOUBLE", "ARRAY<TINYINT>", "transform(x, a -> CAST(greatest(least(a * scale, 127D), -128D) AS TINYINT))"),
    "vector_u8": ("x ARRAY<DOUBLE>, scale DOUBLE", "ARRAY<SMALLINT>", "transform(x, a -> CAST(greatest(least(a * scale, 255D), 0D) AS SMALLINT))"),
    "leading_dims": ("x ARRAY<DOUBLE>, dims INT", "ARRAY<DOUBLE>", "slice(x, 1, dims)"),
    "natural_order": ("name STRING", "STRING", r"array_join(transform(split(name, r'(?<=\D)(?=\d)|(?<=\d)(?=\D)'), a -> CASE WHEN a RLIKE r'^\d+$' THEN lpad(a, 20, '0') ELSE a END), '')"),
    "whole_rate": ("n DOUBLE, seconds DOUBLE", "BIGINT", "CAST(coalesce(floor(try_divide(n, seconds)), 0) AS BIGINT)"),
}


@arrow_udtf(returnType="query_id long, key long, distance double")
class Nearest:
    """The k nearest base rows of a cell for each of its queries."""

    def __init__(self):
        self.asked, self.scan, self.name = [], None, "l2"

    def _matrix(self, column: pa.Array) -> np.ndarray:
        return np.array(column.to_pylist(), dtype=np.int64 if metric(self.name).bits else np.float64)

    def eval(self, k: pa.Array, name: pa.Array, rows: pa.RecordBatch):
        # imported here, as operators import this package
        from ..operators.knn import Scan, check_k

        self.name, side = name[0].as_py(), rows.column("side").to_numpy(zero_copy_only=False)
        check_k(k[0].as_py())
        ids, vectors = rows.column("id").to_numpy(zero_copy_only=False), rows.column("vector")
        some = np.flatnonzero(side == 0)
        if len(some):
            self.asked.append((ids[some], self._matrix(vectors.take(pa.array(some)))))
        some = np.flatnonzero(side != 0)
        if len(some) and self.asked:
            if self.scan is None:
                self.ids, queries = (np.concatenate(c) for c in zip(*self.asked, strict=True))
                self.scan = Scan(queries, k[0].as_py(), self.name)
            self.scan.add(ids[some].astype(np.int64), self._matrix(vectors.take(pa.array(some))))
        return iter(())

    def terminate(self):
        if self.scan is not None:
            found = np.isfinite(self.scan.dist)
            columns = [np.repeat(self.ids.astype(np.int64), found.sum(axis=1)), self.scan.key[found], self.scan.dist[found]]
            yield pa.table([pa.array(c) for c in columns], names=["query_id", "key", "distance"])


def register(spark: SparkSession) -> None:
    """Make all functions known to a session."""
    for name, (kind, body) in DISTANCES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_distance(x {kind}, y {kind}) RETURNS DOUBLE RETURN {body}")
    for name, (parameters, result, body) in OTHERS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("nearest", Nearest)


def nearest_sql(base: str, queries: str, k: int, name: str = "l2", base_blocks: int = 8, query_blocks: int = 1) -> str:
    """A statement for query_id, rank, key, distance. base (key, vector) and queries (query_id, vector) are views or tables.

    Each row is sent to the cells of its row or column of the grid, so base_blocks and query_blocks follow from what a
    task can hold: a block of queries; base rows stream by.
    """
    if min(k, base_blocks, query_blocks) < 1:
        raise ValueError("k and the numbers of blocks must be at least 1")
    kind = "ARRAY<BIGINT>" if metric(name).bits else "ARRAY<DOUBLE>"
    return f"""WITH cells AS (
        SELECT pmod(xxhash64(query_id), {query_blocks}L) AS across, explode(sequence(0L, {base_blocks - 1}L)) AS down, 0 AS side, CAST(query_id AS BIGINT) AS id, CAST(vector AS {kind}) AS vector FROM {queries}
        UNION ALL SELECT explode(sequence(0L, {query_blocks - 1}L)) AS across, pmod(xxhash64(key), {base_blocks}L) AS down, 1 AS side, CAST(key AS BIGINT) AS id, CAST(vector AS {kind}) AS vector FROM {base}),
    near AS (SELECT query_id, key, distance FROM nearest({k}, '{name}', TABLE(cells) PARTITION BY (across, down) ORDER BY side)),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, key) AS BIGINT) AS rank FROM near)
    SELECT query_id, rank, key, distance FROM ranked WHERE rank <= {k}"""
