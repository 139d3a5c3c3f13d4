"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HERE = os.path.dirname(os.path.abspath(__file__))
QUERIES = ["knn_l2", "knn_cos", "knn_manhattan", "knn_hamming", "knn_sharded_merge", "knn_binary_rerank", "knn_i8", "recall_at_10", "ndcg_at_10", "epoch_recall_curve", "knn_lsh", "knn_graph", "insertion_order", "text_lines_escaped"]


def main() -> None:
    sys.path.insert(0, HERE)
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])
    from neargrid.catalog import QUERIES as known
    from neargrid.operators.ann import BoundsIndex, GraphIndex
    from neargrid.operators.knn import knn
    from neargrid.plans import generate
    from neargrid.sources.staging import clear, stage

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known["knn_l2"](spark, sf_dir).count()  # start the Python workers
    took = {}

    def timed(name: str, df) -> None:
        began = time.time()
        df().write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()

    for name in QUERIES:
        timed(name, lambda name=name: known[name](spark, sf_dir))
    asked = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 10 = 0").count()
    # a generated base, large enough that the scan and not the start of jobs is timed: rows of few inner dimensions, as embeddings are
    rows, dims, queries = 100_000, 100, 10_000
    base = generate.embedded(spark, rows, dims, 16).withColumnRenamed("row", "key")
    some = generate.embedded(spark, queries, dims, 16, first=1 << 40).withColumnRenamed("row", "query_id")
    base = stage(base.repartition(int(cpus)), codec="uncompressed")
    some = stage(some)
    timed("generated_knn_l2", lambda: knn(base, some, 10))
    codes = BoundsIndex("l2")
    codes.add(base)
    timed("generated_bounds_scan", lambda: codes.search(some, 10))
    index = GraphIndex("l2", block_rows=1_500)
    began = time.time()
    index.add(base)
    took["generated_graph_add"] = round(time.time() - began, 3)
    timed("generated_graph_search", lambda: index.search(some, 10))
    truth = stage(knn(base, some, 10))

    def found() -> float:
        hit = index.search(some, 10).select("query_id", "key", F.lit(1).alias("hit"))
        return round(truth.join(hit, ["query_id", "key"], "left").agg(F.count("hit") / F.count("*")).first()[0], 4)

    recall, index.hops = found(), 0
    timed("generated_graph_search_without_hops", lambda: index.search(some, 10))
    recall_without = found()
    rates = {
        "queries_per_sec_knn_l2": round(asked / took["knn_l2"], 1),
        "queries_per_sec_generated_knn_l2": round(queries / took["generated_knn_l2"], 1),
        "distances_per_sec_generated_knn_l2": round(queries * rows / took["generated_knn_l2"]),
        "queries_per_sec_generated_bounds_scan": round(queries / took["generated_bounds_scan"], 1),
        "fetched_a_query_generated_bounds_scan": round(codes.fetches.agg(F.avg("fetched")).first()[0], 2),
        "rows_per_sec_generated_graph_add": round(rows / took["generated_graph_add"], 1),
        "queries_per_sec_generated_graph_search": round(queries / took["generated_graph_search"], 1),
        "lists_generated_graph": len(index.centres),
        "found_of_10_nearest_generated_graph_search": recall,
        "queries_per_sec_generated_graph_search_without_hops": round(queries / took["generated_graph_search_without_hops"], 1),
        "found_of_10_nearest_generated_graph_search_without_hops": recall_without,
    }
    clear(spark)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "rates": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
