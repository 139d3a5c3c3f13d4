"""Reports of runs: one JSON file for each configuration, and tables over many of them."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import config_label

STEP = ["vectors_indexed", "add_elapsed", "add_throughput", "memory_bytes", "search_elapsed", "search_throughput", "recall_at_1", "recall_at_10", "ndcg_at_10", "recall_at_1_normalized", "recall_at_10_normalized", "ndcg_at_10_normalized"]
#: Series of the charts: name and column against vectors_indexed.
CHARTS = {"add_throughput": "add_throughput", "search_throughput": "search_throughput", "recall_at_1": "recall_at_1_normalized", "recall_at_10": "recall_at_10_normalized", "ndcg_at_10": "ndcg_at_10_normalized", "memory": "memory_bytes", "search_seconds": "search_elapsed"}


def config_hash(config: dict) -> str:
    """Six hex digits of the sorted configuration."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:6]


def path_of(directory: str, name: str, config: dict) -> str:
    return os.path.join(directory, f"{name}-{config_hash(config)}.json")


def save(path: str, machine: dict, dataset: dict, config: dict, steps: list[dict]) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    steps = [{k: v for k, v in s.items() if v is not None} for s in steps]
    with open(f"{path}.tmp", "w") as f:
        json.dump({"machine": machine, "dataset": dataset, "config": config, "steps": steps}, f, indent=1)
    os.replace(f"{path}.tmp", path)


def load(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(f"{directory}/*.json").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def label(reports: DataFrame):
    """The name of each report's series; a report without a backend in its configuration goes by its file name."""
    held = reports.schema["config"].dataType
    known = {f.name for f in held.fields} if hasattr(held, "fields") else set()
    part = lambda name, kind: F.col(f"config.{name}").cast(kind) if name in known else F.lit(None).cast(kind)
    backend = F.coalesce(part("backend", "string"), F.regexp_replace("file", r"-[0-9a-f]{6}\.json$", ""))
    return config_label(backend, part("dtype", "string"), part("metric", "string"), *(part(n, "bigint") for n in ("connectivity", "expansion_add", "expansion_search", "shards")))


def series(reports: DataFrame) -> DataFrame:
    """chart, label, vectors_indexed, value: what the charts show."""
    each = reports.select(label(reports).alias("label"), F.explode("steps").alias("s"))
    pairs = F.array(*[F.struct(F.lit(c).alias("chart"), F.col(f"s.{col}").cast("double").alias("value")) for c, col in CHARTS.items()])
    return each.select("label", F.col("s.vectors_indexed").alias("vectors_indexed"), F.explode(pairs).alias("p")).select("p.chart", "label", "vectors_indexed", "p.value")


def peak_memory(reports: DataFrame) -> DataFrame:
    """The largest index of each report, and the largest heaps: of one executor, and of all together."""
    held = reports.schema["steps"].dataType.elementType.fieldNames()
    peak = lambda step, name: F.max(f"s.{step}" if step in held else F.lit(None).cast("bigint")).alias(name)
    each = reports.select("file", F.explode("steps").alias("s"))
    return each.groupBy("file").agg(F.max("s.memory_bytes").alias("peak_memory_bytes"), peak("peak_heap_bytes", "peak_heap_bytes"), peak("sum_of_peaks_heap_bytes", "sum_of_peaks_heap_bytes"))


def peak_by(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The largest value of each key."""
    return df.groupBy(key).agg(F.max(value).alias(name))


def rate(counter, per):
    """A counter per unit of another one, which counts as one if it is less (instructions a cycle, misses a reference)."""
    return counter.cast("double") / F.greatest(per, F.lit(1))
