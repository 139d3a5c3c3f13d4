"""Exact search among bit vectors that does not look at all of them.

`hamming_index` finds the k nearest by Hamming distance with one table for each piece of at most 16 bits of a code: two codes that differ in fewer
than m (s + 1) of m pieces' bits differ in at most s bits of some piece. Radius s grows until the k-th distance found is below
that bound; each round joins only the values at exactly distance s, for the queries that are not done. Queries that are not done
at `max_radius`, or where listing values would cost more than a scan, are scanned: the result is exact for all.

`popcount_search` finds the k nearest by Jaccard (Tanimoto) or Sorensen distance: the numbers of set bits of two vectors bound
their distance from below. Rows are kept by that number; a query looks into the numbers nearest to its own that
hold k rows, and then into those alone whose bound does not exceed the k-th distance. Numbers with many rows are cut into
blocks, so that a task holds a bounded part.

base: key, vector array<bigint>; queries: query_id, vector; `bits` set bits of a vector lie below that number. Ids and keys are distinct.
Results are those of `knn`, ties included; where the base has fewer than k rows, all of them.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .knn import Scan, check_k, knn, matrix, top_k

PIECE = 16
#: A round of up to so many values and pairs is always made; in a larger one each counts as so many rows of a scan.
ROUND, LISTED = 1 << 24, 32


def cut(word, bits: int) -> list[Column]:
    """The pieces of a code whose 64-bit words `word` gives by number: as few as can be of at most PIECE bits, of equal width but for
    one bit, as a short one would have too few values."""
    m, out = -(-bits // PIECE), []
    for a, b in ((i * bits // m, (i + 1) * bits // m) for i in range(m)):
        some = F.shiftrightunsigned(word(a // 64), a % 64)
        if a // 64 != (b - 1) // 64:
            some = some.bitwiseOR(F.shiftleft(word(a // 64 + 1), 64 - a % 64))
        out.append(some.bitwiseAND(F.lit((1 << (b - a)) - 1)).cast("int"))
    return out


def pieces(vector: str, bits: int) -> Column:
    """(piece, value) of the pieces of a code."""
    return F.posexplode(F.array(*cut(lambda i: F.col(vector)[i], bits))).alias("piece", "value")


def flips(radius: int) -> list[int]:
    """All values of 16 bits with so many set."""
    return [sum(1 << b for b in on) for on in itertools.combinations(range(PIECE), radius)]


def piece_table(base: DataFrame, bits: int) -> DataFrame:
    return base.select(F.col("key").cast("long").alias("key"), "vector", pieces("vector", bits))


def worth_listing(probes: DataFrame, values: DataFrame, each: int, n_queries: int, rows: int) -> bool:
    """Whether a round is small, or less work than a scan. probes: piece, value, n of the queries' pieces before bits are flipped in them,
    each of which gives `each` values a query; values: piece, value, held of the base."""
    if max(each * n_queries, 1) > ROUND and each * LISTED >= rows:
        return False
    pairs = probes.join(values.hint("merge"), ["piece", "value"]).agg(F.sum(F.col("n") * F.col("held")).alias("pairs")).first()["pairs"] or 0
    return pairs <= ROUND or (pairs + each * n_queries) * LISTED < n_queries * rows


def hamming_index(base: DataFrame, queries: DataFrame, k: int, bits: int, max_radius: int = 3, table: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, rank, key, distance) of the k nearest, and (query_id, radius, candidates): how many rows each round compared with it.
    A query that was scanned has a row with radius -1. table: a stored `piece_table`.

    Pairs are compared where they meet and never stored: a pair belongs to the round of its nearest piece and, there, to the first such
    piece, so it comes once; what is kept are k rows a query. A large round that would be more work than a scan is left out.
    """
    check_k(k)
    table, m, rows = stage(piece_table(base, bits)) if table is None else table, -(-bits // PIECE), base.count()
    values = stage(table.groupBy("piece", "value").agg(F.count("*").alias("held")))  # at most 2^PIECE a piece
    open_ = stage(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").alias("query")))
    found = open_.sparkSession.createDataFrame([], "query_id long, key long, distance double")
    done, counts, left = [], [], open_.count()
    apart = [F.bit_count(x).cast("int") for x in cut(lambda i: F.col("query")[i].bitwiseXOR(F.col("vector")[i]), bits)]
    whole = sum(apart[1:], apart[0]).cast("double")
    least = F.least(*apart) if m > 1 else apart[0]
    for radius in range(max_radius + 1):
        near = F.explode(F.expr(f"array({', '.join(map(str, flips(radius)))})")).alias("flip")
        flipped = F.col("value").bitwiseXOR(F.col("flip")).alias("value")
        own = open_.select(pieces("query", bits)).groupBy("piece", "value").agg(F.count("*").alias("n"))
        if not left or not worth_listing(own.select("piece", "value", "n", near).select("piece", "n", flipped), values, m * len(flips(radius)), left, rows):
            break
        bars = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("bar"))
        probes = open_.join(bars, "query_id", "left").select("query_id", "query", "bar", pieces("query", bits)).select("query_id", "query", "bar", "piece", "value", near)
        probes = probes.select("query_id", "query", "bar", "piece", flipped)
        first = F.coalesce(*(F.when(d == radius, F.lit(i)) for i, d in enumerate(apart)))
        # shuffled and sorted: the planner does not see how far the flips multiply the queries, and would broadcast them
        pairs = probes.join(table.hint("merge"), ["piece", "value"]).where((least >= radius) & (first == F.col("piece")))
        counts.append(pairs.groupBy("query_id").agg(F.count("*").alias("candidates")).select("query_id", F.lit(radius).alias("radius"), "candidates"))
        new = pairs.select("query_id", "key", whole.alias("distance"), "bar").where(F.col("bar").isNull() | (F.col("distance") <= F.col("bar"))).drop("bar")
        best = stage(top_k(found.unionByName(new), k))
        # all rows up to this distance have been found
        bound = m * (radius + 1) - 1
        full = best.where((F.col("rank") == min(k, rows)) & (F.col("distance") <= bound)).select("query_id")
        done.append(best.join(full, "query_id", "left_semi").select("query_id", "rank", "key", "distance"))
        open_ = stage(open_.join(full, "query_id", "left_anti"))
        found, left = stage(best.join(full, "query_id", "left_anti").select("query_id", "key", "distance")), open_.count()
    if left or not done:
        done.append(knn(base, open_.withColumnRenamed("query", "vector"), k, "hamming"))
        counts.append(open_.select("query_id", F.lit(-1).alias("radius"), F.lit(rows).cast("bigint").alias("candidates")))
    result, seen = done[0], counts[0]
    for a in done[1:]:
        result = result.unionByName(a)
    for a in counts[1:]:
        seen = seen.unionByName(a)
    return result, seen


def least_distance(name: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least distance that vectors with a and b set bits can have."""
    low, high, both = np.minimum(a, b), np.maximum(a, b), a + b
    if name == "jaccard":
        return np.where(high == 0, 0.0, 1.0 - low / np.maximum(high, 1))
    return np.where(both == 0, 0.0, 1.0 - 2 * low / np.maximum(both, 1))


def popcount_search(base: DataFrame, queries: DataFrame, k: int, name: str = "jaccard", block_rows: int = 8192) -> tuple[DataFrame, DataFrame]:
    """(query_id, rank, key, distance) of the k nearest, and (query_id, compared): the rows that a query was compared with."""
    check_k(k)
    if name not in ("jaccard", "sorensen"):
        raise ValueError("name must be jaccard or sorensen")
    ones = F.aggregate("vector", F.lit(0).cast("bigint"), lambda s, w: s + F.bit_count(w))
    counted = base.select(F.col("key").cast("long").alias("key"), F.col("vector").alias("vector"), ones.alias("ones"))
    sizes = counted.groupBy("ones").agg(F.count("*").alias("n")).orderBy("ones").collect()  # at most one row for each number of bits
    numbers, n = (np.array([r[c] for r in sizes], dtype=np.int64) for c in ("ones", "n"))
    cuts = -(-n // block_rows)
    split = F.when(F.lit(False), F.lit(1))
    for number, cut in zip(numbers.tolist(), cuts.tolist(), strict=True):
        if cut > 1:
            split = split.when(F.col("ones") == number, F.lit(cut))
    placed = counted.withColumn("block", F.pmod(F.xxhash64("key"), split.otherwise(F.lit(1))))
    asked = stage(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").alias("vector"), ones.alias("own")))

    def routed(df: DataFrame, second: bool) -> DataFrame:
        """query_id, vector, ones, block: first, the numbers nearest to the query's own that hold k rows; second, the others that its bar allows."""

        def run(batches):
            for batch in batches:
                own = batch.column(2).to_numpy()
                out = []
                for i in range(batch.num_rows):
                    least = least_distance(name, own[i], numbers)
                    order = np.lexsort((numbers, least))
                    first = int(np.searchsorted(np.cumsum(n[order]), k)) + 1
                    some = order[:first]
                    if second:
                        some = order[first:]
                        some = some[least[some] <= batch.column(3)[i].as_py()]
                    out += [(i, int(numbers[c]), b) for c in some for b in range(int(cuts[c]))]
                of, at, block = (pa.array([r[j] for r in out], pa.int64()) for j in range(3))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), at, block], names=["query_id", "vector", "ones", "block"])

        return df.mapInArrow(run, "query_id long, vector array<bigint>, ones long, block long")

    def compare(cell: tuple, some: pa.Table, rows: pa.Table) -> pa.Table:
        out = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)]
        if some.num_rows and rows.num_rows:
            best = Scan(matrix(some.column("vector").combine_chunks(), True), k, name)
            best.add(rows.column("key").to_numpy(), matrix(rows.column("vector").combine_chunks(), True))
            found = np.isfinite(best.dist)
            ids = np.repeat(some.column("query_id").to_numpy(), found.sum(axis=1))
            first = np.append(True, ids[1:] != ids[:-1]) if len(ids) else np.zeros(0, dtype=bool)
            out = [ids, best.key[found], best.dist[found], np.where(first, rows.num_rows, 0)]
        return pa.table([pa.array(c) for c in out], names=["query_id", "key", "distance", "compared"])

    def look(df: DataFrame) -> DataFrame:
        cells = df.groupBy("ones", "block").cogroup(placed.select("ones", "block", "key", "vector").groupBy("ones", "block"))
        return cells.applyInArrow(compare, "query_id long, key long, distance double, compared long")

    one = stage(look(routed(asked, False)))
    bars = top_k(one, k).groupBy("query_id").agg(F.max("distance").alias("bar"))
    two = stage(look(routed(asked.join(bars, "query_id").select("query_id", "vector", "own", "bar"), True)))
    both = one.unionByName(two)
    return top_k(both, k).select("query_id", "rank", "key", "distance"), both.groupBy("query_id").agg(F.sum("compared").alias("compared"))
