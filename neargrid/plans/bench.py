"""Growing an index in epochs, searching after each, over a grid of configurations."""

from __future__ import annotations

import itertools
import os
import platform
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import evaluate, sampling
from ..operators.ann import VectorIndex
from ..operators.knn import check_k, knn
from . import measure, report


@dataclass
class BenchSpec:
    """What is measured. truth: query_id, rank, key; K is the number of neighbours it has for each query."""

    base: DataFrame
    queries: DataFrame
    truth: DataFrame
    k: int
    epochs: int = 10
    shuffle: bool = True
    max_base_vectors: int | None = None
    dimensions: int | None = None
    output: str | None = None

    def __post_init__(self):
        if self.epochs < 1:
            raise ValueError("epochs must be at least 1")
        check_k(self.k)
        if self.output and os.path.isfile(self.output):
            raise ValueError(f"output {self.output} is not a directory")
        if self.max_base_vectors is not None:
            self.base = sampling.capped(self.base, self.max_base_vectors)
        if self.dimensions:
            for name in ("base", "queries"):
                setattr(self, name, getattr(self, name).withColumn("vector", F.slice("vector", 1, self.dimensions)))


def epoch_curve(base: DataFrame, queries: DataFrame, k: int, epochs: int, total: int, metric: str = "l2") -> DataFrame:
    """step, query_id, rank, key, distance: a search of the cumulative base after each epoch, in one scan of the base.

    base: row, key, vector. Top-k is mergeable: each epoch's own k nearest are found once, and step s keeps the k nearest
    of the epochs up to s. Work grows with the base, not with base times epochs.
    """
    each = knn(base.withColumn("epoch", sampling.epoch_of(F.col("row"), total, epochs)), queries, k, metric, by="epoch")
    steps = base.sparkSession.range(epochs).withColumnRenamed("id", "step")
    upto = each.drop("rank").join(F.broadcast(steps), F.col("epoch") <= F.col("step"))
    w = Window.partitionBy("step", "query_id").orderBy("distance", "key")
    return upto.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k).select("step", "query_id", "rank", "key", "distance")


def run(spec: BenchSpec, index: VectorIndex) -> list[dict]:
    """Add epoch by epoch to a backend with state; search and score all queries after each. Every step also holds the rows that
    its plans have seen, and memory, bytes and failed tasks of the executors (`measure`)."""
    total, spark = spec.base.count(), spec.base.sparkSession
    placed = sampling.insertion_order(spec.base, shuffle=spec.shuffle).persist()
    n_queries, steps = spec.queries.count(), []
    for epoch, first, rows in sampling.epoch_sizes(total, spec.epochs):
        before, began, went_in, came_out = measure.executors(spark), time.time(), measure.Rows(f"added {epoch}"), measure.Rows(f"found {epoch}")
        if rows:
            index.add(went_in.through(placed.where((F.col("perm") >= first) & (F.col("perm") < first + rows)).select(F.col("row").alias("key"), "vector")))
        added = time.time() - began
        began = time.time()
        results = index.search(spec.queries, spec.k).persist()
        came_out.through(results).count()
        searched = time.time() - began
        seen = {"rows_added": went_in.get() if rows else 0, "rows_found": came_out.get(), **measure.between(before, measure.executors(spark))}
        steps.append(step_entry(results, spec, first + rows, total, rows, added, n_queries, searched, index.size_bytes()) | seen)
        results.unpersist()
    placed.unpersist()
    return steps


def search_only(spec: BenchSpec, index: VectorIndex) -> list[dict]:
    """One step over a loaded index: nothing is added, raw metrics are the normalised ones."""
    total = spec.base.count()
    began = time.time()
    results = index.search(spec.queries, spec.k).persist()
    results.count()
    return [step_entry(results, spec, total, total, 0, 0.0, spec.queries.count(), time.time() - began, index.size_bytes())]


def step_entry(results, spec, indexed, total, rows, added, n_queries, searched, size) -> dict:
    scores = {
        "recall_at_1": evaluate.recall(results, spec.truth, 1, queries=spec.queries).first()[0],
        "recall_at_10": evaluate.recall(results, spec.truth, 10, queries=spec.queries).first()[0],
        "ndcg_at_10": evaluate.ndcg(results, spec.truth, 10, queries=spec.queries).first()[0],
    }
    share = indexed / total if total else 0.0
    norm = {f"{k}_normalized": min(v / share, 1.0) if share and v else 0.0 for k, v in scores.items()}
    speed = lambda n, s: int(n / s) if s > 0 else 0
    return {"vectors_indexed": indexed, "add_elapsed": added, "add_throughput": speed(rows, added), "memory_bytes": size, "search_elapsed": searched, "search_throughput": speed(n_queries, searched), **scores, **norm}


def grid(**axes) -> Iterator[dict]:
    """All combinations of the axes' values."""
    names = sorted(axes)
    for values in itertools.product(*(axes[n] for n in names)):
        yield dict(zip(names, values, strict=True))


def check_single(index_path: str | None, configs: list[dict]) -> None:
    """An index that is saved or loaded has one path, so only one configuration can use it."""
    if index_path and len(configs) > 1:
        raise ValueError(f"an index path needs one configuration, not {len(configs)}")


def counts_by(df: DataFrame, column: str, name: str = "outcome") -> DataFrame:
    """How often each outcome occurred."""
    return df.groupBy(F.col(column).alias(name)).agg(F.count("*").alias("n"))


def factory_string(data_type: str, connectivity: int) -> str:
    """Name of a graph index over a storage type, in the notation of index factories."""
    # fixed values
    storage = {"f32": "Flat", "f16": "SQfp16", "bf16": "SQbf16", "u8": "SQ8_direct", "i8": "SQ8_direct_signed"}
    if data_type == "b1":
        return f"BHNSW{connectivity}"
    if data_type not in storage:
        raise ValueError(f"unknown data type {data_type!r}; known: {sorted([*storage, 'b1'])}")
    return f"IDMap,HNSW{connectivity},{storage[data_type]}"


def sweep(spec: BenchSpec, build: Callable[[dict], VectorIndex], configs: list[dict], name: str = "index", index_path: str | None = None) -> dict[str, int]:
    """Run every configuration; a failed one is recorded and the sweep goes on. Reports go to spec.output, and the index of
    the only configuration to index_path."""
    check_single(index_path, configs)
    outcomes = {"ran": 0, "skipped": 0, "failed": 0}
    for config in configs:
        path = report.path_of(spec.output, name, config) if spec.output else None
        if path and os.path.exists(path):
            outcomes["skipped"] += 1
            continue
        try:
            index = build(config)
            steps = run(spec, index)
            if index_path:
                index.save(index_path)
        except Exception as e:
            print(f"{config}: {type(e).__name__}: {str(e)[:200]}")
            outcomes["failed"] += 1
            continue
        if path:
            report.save(path, machine(spec.base.sparkSession), {"vectors_count": spec.base.count(), "queries_count": spec.queries.count(), "neighbors_per_query": spec.k}, config, steps)
        outcomes["ran"] += 1
    return outcomes


def machine(spark: SparkSession) -> dict:
    pages = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    return {"cpu_model": platform.processor() or platform.machine(), "logical_cores": os.cpu_count(), "ram_bytes": pages, "default_parallelism": spark.sparkContext.defaultParallelism, "driver_rss_bytes": resident_bytes()}


def resident_bytes() -> int:
    """Resident memory of this process."""
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
