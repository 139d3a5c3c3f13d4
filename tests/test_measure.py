import numpy as np
from pyspark.sql import functions as F

from neargrid.operators import ann
from neargrid.operators.knn import knn
from neargrid.plans import bench, measure, report


def table(spark, x, name):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} bigint, vector array<float>")


def test_rows_are_counted_by_the_action_itself(spark):
    seen = measure.Rows("some")
    assert seen.through(spark.range(1000).where("id % 3 = 0")).agg(F.sum("id")).first()[0] == 166833
    assert seen.get() == 334
    assert measure.Rows("none").get(patience=0.1) is None


def test_executors_grow_by_what_a_job_reads(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(50_000).write.parquet(path)
    before = measure.executors(spark)
    spark.read.parquet(path).repartition(3).count()
    after = measure.executors(spark)
    got = measure.between(before, after)
    assert got["input_bytes"] > 0 and got["shuffle_write_bytes"] > 0 and got["failed_tasks"] == 0
    # an executor that came meanwhile counts from its start, and a lost one keeps its counters
    one = {"a": dict.fromkeys([*measure.TOTALS, *measure.PEAKS], 5)}
    two = {"a": dict.fromkeys(one["a"], 7), "b": dict.fromkeys(one["a"], 3)}
    got = measure.between(one, two)
    assert got["input_bytes"] == 5 and got["peak_heap_bytes"] == 7 and got["sum_of_peaks_heap_bytes"] == 10


def test_a_run_reports_rows_and_memory(spark, tmp_path):
    x = np.random.default_rng(2).standard_normal((90, 6)).astype(np.float32)
    base, asked = table(spark, x, "row"), table(spark, x[:7], "query_id")
    truth = knn(base.withColumnRenamed("row", "key"), asked, 5).drop("distance")
    for name, index in (("flat", ann.FlatIndex()), ("bounds", ann.BoundsIndex())):
        spec = bench.BenchSpec(base, asked, truth, 5, epochs=4, output=str(tmp_path / name))
        assert bench.sweep(spec, lambda config, index=index: index, [{"backend": name, "shards": 2}], name) == {"ran": 1, "skipped": 0, "failed": 0}
        back = report.load(spark, str(tmp_path / name))
        steps = back.select(F.explode("steps").alias("s")).select("s.*").orderBy("vectors_indexed").collect()
        assert [s.rows_added for s in steps] == [23, 23, 23, 21] and [s.rows_found for s in steps] == [35] * 4
        assert all(s.input_bytes >= 0 and s.failed_tasks == 0 and s.peak_heap_bytes >= 0 for s in steps) and steps[-1].recall_at_1 == 1.0
        assert report.peak_memory(back).first().peak_memory_bytes == steps[-1].memory_bytes
        assert {r.label for r in report.series(back).select("label").distinct().collect()} == {f"{name} · 2s"}
