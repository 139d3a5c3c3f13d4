import numpy as np
import pytest
from pyspark.sql import functions as F

from neargrid.functions import metrics, quantize, sql, text
from neargrid.operators.knn import knn


def table(spark, x, name, kind="float"):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], f"{name} bigint, vector array<{kind}>")


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    sql.register(spark)


@pytest.mark.parametrize("name", sorted(metrics.METRICS))
def test_functions_equal_the_expressions(spark, name):
    r = np.random.default_rng(3)
    x = r.integers(-(1 << 62), 1 << 62, (12, 3)) if metrics.METRICS[name].bits else r.standard_normal((12, 6)).astype(np.float32)
    x[3] = 0
    x = np.abs(x) if name == "divergence" else x
    kind = "bigint" if metrics.METRICS[name].bits else "float"
    pairs = table(spark, x, "a", kind).crossJoin(table(spark, x, "b", kind).withColumnRenamed("vector", "other"))
    pairs.createOrReplaceTempView("pairs")
    want = pairs.select("a", "b", metrics.metric(name).column(F.col("vector"), F.col("other")).alias("d")).orderBy("a", "b").collect()
    got = spark.sql(f"SELECT a, b, {name}_distance(vector, other) AS d FROM pairs ORDER BY a, b")
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    digits = 9 if name == "haversine" else None
    same = (lambda v: round(v, digits)) if digits else (lambda v: v)
    assert [same(r.d) for r in got.collect()] == [same(r.d) for r in want] and len(want) == 144


@pytest.mark.parametrize("name, blocks", [("l2", (1, 1)), ("cos", (3, 2)), ("manhattan", (5, 3)), ("jaccard", (2, 2))])
def test_table_function_equals_the_scan(spark, name, blocks):
    r = np.random.default_rng(4)
    bits = metrics.METRICS[name].bits
    x = r.integers(0, 1 << 20, (150, 2)) if bits else np.round(r.standard_normal((150, 4)), 1).astype(np.float32)
    base, asked = table(spark, x, "key", "bigint" if bits else "float"), table(spark, x[:20], "query_id", "bigint" if bits else "float")
    base.createOrReplaceTempView("b")
    asked.createOrReplaceTempView("q")
    got = spark.sql(sql.nearest_sql("b", "q", 6, name, *blocks)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, knn(base, asked, 6, name).collect())) and len(got) == 120


def test_table_function_of_few_or_no_rows(spark):
    x = np.eye(3, dtype=np.float32)
    table(spark, x, "key").createOrReplaceTempView("b")
    table(spark, x, "query_id").createOrReplaceTempView("q")
    spark.sql("SELECT * FROM b WHERE false").createOrReplaceTempView("no_b")
    spark.sql("SELECT * FROM q WHERE false").createOrReplaceTempView("no_q")
    count = lambda b, q, k: spark.sql(sql.nearest_sql(b, q, k, base_blocks=2, query_blocks=2)).count()
    assert [count("b", "q", 5), count("no_b", "q", 5), count("b", "no_q", 5)] == [9, 0, 0]
    with pytest.raises(ValueError):
        sql.nearest_sql("b", "q", 0)
    with pytest.raises(Exception, match="k must be at least 1"):
        spark.sql("SELECT * FROM nearest(0, 'l2', TABLE(SELECT 0 AS side, query_id AS id, vector FROM q) PARTITION BY id ORDER BY side)").collect()


def test_vector_and_text_functions(spark):
    spark.createDataFrame([([200.7, -1.9, -300.0, 0.5], "shard_10", 7.0, 2.0), (None, None, None, 0.0)], "v array<double>, n string, a double, s double").createOrReplaceTempView("t")
    got = spark.sql("SELECT vector_i8(v, 1D) AS i, vector_u8(v, 2D) AS u, leading_dims(v, 2) AS l, natural_order(n) AS n, whole_rate(a, s) AS w FROM t").collect()
    want = spark.table("t").select(quantize.to_integer(F.col("v"), "i8").alias("i"), quantize.to_integer(F.col("v"), "u8", 2.0).alias("u"), quantize.truncated(F.col("v"), 2).alias("l"), text.natural_order(F.col("n")).alias("n"), text.throughput(F.col("a"), F.col("s")).alias("w")).collect()
    assert got == want
