"""What Spark itself has seen of a run: rows that went through a plan, and memory, bytes and failures of the executors.

Rows come from observations, which ride along with an action that takes place anyway. The other figures are those of
the status store, which the driver keeps of all executors, lost ones included; nothing runs on executors for them.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Counters of an executor since its start, by the name they have here.
TOTALS = {"input_bytes": "totalInputBytes", "shuffle_read_bytes": "totalShuffleRead", "shuffle_write_bytes": "totalShuffleWrite", "task_millis": "totalDuration", "failed_tasks": "failedTasks"}
#: Peaks of an executor. Those of process trees need spark.executor.processTreeMetrics.enabled, and are 0 without it.
PEAKS = {"heap_bytes": "JVMHeapMemory", "off_heap_bytes": "JVMOffHeapMemory", "execution_bytes": "OnHeapExecutionMemory", "storage_bytes": "OnHeapStorageMemory", "jvm_rss_bytes": "ProcessTreeJVMRSSMemory", "python_rss_bytes": "ProcessTreePythonRSSMemory"}


class Rows:
    """The number of rows that pass `through` a plan, known after its first action has read all of it."""

    def __init__(self, name: str):
        self.observation = Observation(name)

    def through(self, df: DataFrame) -> DataFrame:
        return df.observe(self.observation, F.count(F.lit(1)).alias("rows"))

    def get(self, patience: float = 10.0) -> int | None:
        """None if no action has reported within `patience` seconds."""
        end = time.time() + patience
        while self.observation._jo is None or not self.observation._jo.future().isCompleted():
            if time.time() > end or self.observation._jo is None:  # in no plan
                return None
            time.sleep(0.02)
        return self.observation.get["rows"]


def executors(spark: SparkSession) -> dict[str, dict[str, int]]:
    """For each executor, the driver's among them, its counters and peaks. Peaks arrive with heartbeats and ended tasks."""
    every, out = spark.sparkContext._jsc.sc().statusStore().executorList(False).iterator(), {}
    while every.hasNext():
        e = every.next()
        peak = e.peakMemoryMetrics()
        held = {k: peak.get().getMetricValue(name) if peak.isDefined() else 0 for k, name in PEAKS.items()}
        out[e.id()] = {k: getattr(e, name)() for k, name in TOTALS.items()} | held
    return out


def between(before: dict, after: dict) -> dict[str, int]:
    """Counters of all executors since `before`, and their peaks: the largest of one executor, and the sum over all."""
    out = {k: sum(e[k] - before.get(i, {}).get(k, 0) for i, e in after.items()) for k in TOTALS}
    for k in PEAKS:
        out[f"peak_{k}"] = max((e[k] for e in after.values()), default=0)
        out[f"sum_of_peaks_{k}"] = sum(e[k] for e in after.values())
    return out
