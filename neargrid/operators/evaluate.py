"""Ranking quality against ground truth.

results: query_id, rank (from 1), key. truth: query_id, rank (from 1), key. Both stay distributed; what is joined is
(query_id, key).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def truth_table(wide: DataFrame) -> DataFrame:
    """(query_id, neighbors) to (query_id, rank, key)."""
    return wide.select("query_id", F.posexplode("neighbors").alias("pos", "key")).select("query_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "key")


def found_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id").agg(F.count("*").alias("found"))


def _mean(gains: DataFrame, results: DataFrame, truth: DataFrame, queries: DataFrame | None, by: tuple[str, ...], name: str) -> DataFrame:
    """Sum of gains over the number of all queries: those given, or those with results or ground truth."""
    asked = queries.select("query_id") if queries is not None else results.select("query_id").unionByName(truth.select("query_id"))
    n = asked.distinct().agg(F.count("*").alias("__n"))  # one row
    if by:
        sums = results.select(*by).distinct().join(gains.groupBy(*by).agg(F.sum("gain").alias("__sum")), list(by), "left")
    else:
        sums = gains.agg(F.sum("gain").alias("__sum"))
    return sums.crossJoin(F.broadcast(n)).select(*by, F.coalesce(F.try_divide(F.col("__sum").cast("double"), F.col("__n")), F.lit(0.0)).alias(name))


def recall(results: DataFrame, truth: DataFrame, k: int, *by: str, queries: DataFrame | None = None) -> DataFrame:
    """Share of queries whose rank-1 true neighbour is among the first k results (for each value of `by`).

    Counted over all queries: one without results, or without ground truth, is a miss.
    """
    first = truth.where("rank = 1").select("query_id", "key")
    hits = results.where(F.col("rank") <= k).join(first, ["query_id", "key"]).select(*by, "query_id").distinct()
    return _mean(hits.withColumn("gain", F.lit(1.0)), results, truth, queries, by, "recall")


def discount(rank):
    return 1.0 / F.log2(rank.cast("double") + 1.0)


def ndcg(results: DataFrame, truth: DataFrame, k: int, *by: str, queries: DataFrame | None = None) -> DataFrame:
    """Mean NDCG@k over all queries with binary relevance: a result counts if it is among the first min(k, truth) true
    neighbours. A query without results, or without ground truth, counts as 0."""
    relevant = truth.where(F.col("rank") <= k)
    ideal = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    best = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda a, r: a + discount(r))
    scored = results.where(F.col("rank") <= k).join(relevant.select("query_id", "key"), ["query_id", "key"])
    gained = scored.groupBy(*by, "query_id").agg(F.sum(discount(F.col("rank"))).alias("dcg"))
    gains = gained.join(ideal, "query_id").withColumn("gain", F.col("dcg") / best)
    return _mean(gains, results, truth, queries, by, "ndcg")


def membership(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Results with the rank that each has among the true neighbours (null: none)."""
    return results.join(truth.select("query_id", "key", F.col("rank").alias("true_rank")), ["query_id", "key"], "left")


def normalized(raw, indexed, total):
    """A metric over a part of the base as a share of what that part could reach, at most 1."""
    share = indexed / total
    return F.when((indexed == 0) | (total == 0), 0.0).otherwise(F.least(raw / F.when(share == 0, 1.0).otherwise(share), F.lit(1.0)))


def ideal_gain(k: int) -> float:
    return sum(1 / math.log2(r + 1) for r in range(1, k + 1))
