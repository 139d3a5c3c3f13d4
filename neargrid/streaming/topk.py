"""Nearest neighbours of a stated query set over a stream of base rows.

Top-k is mergeable, so the state is the k best rows of each query: each micro-batch's own k nearest are merged with it.
The state is a Parquet table of |queries| * k rows for each version; a batch that is replayed after a failure writes its own version
anew and reads the one before it, so every row counts once. Versions that no replay can read are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.knn import knn, top_k

STATE = "query_id bigint, rank bigint, key bigint, distance double"


def version(spark: SparkSession, path: str, batch: int) -> DataFrame:
    return spark.read.schema(STATE).parquet(f"{path}/version={batch}") if batch >= 0 else spark.createDataFrame([], STATE)


def forget(spark: SparkSession, path: str, batch: int) -> None:
    """Delete a version."""
    if batch >= 0:
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={batch}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def follow(stream: DataFrame, queries: DataFrame, k: int, state: str, checkpoint: str, metric: str = "l2", once: bool = False) -> StreamingQuery:
    """stream: key, vector. The k nearest so far are in the newest version below `state`."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = version(spark, state, number - 1)
        now = before.drop("rank").unionByName(knn(batch, queries, k, metric).drop("rank"))
        top_k(now, k).select("query_id", "rank", "key", "distance").coalesce(1).write.mode("overwrite").parquet(f"{state}/version={number}")
        forget(spark, state, number - 2)  # a replay of this batch reads the version before it

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
