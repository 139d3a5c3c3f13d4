"""Queries over the driver's tables and, where SQL can express them, the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import quantize, sql, text
from .functions.metrics import metric
from .operators import binary, evaluate, sampling
from .operators.ann import FlatIndex, GraphIndex, SignLsh, memory_bytes
from .operators.bounds import BoundsIndex
from .operators.descent import detours, ranked_lists
from .operators.knn import knn, knn_grid, knn_join, merge_shards, padded, radius_count, rerank, top_k, translate_labels
from .plans import bench, generate, report
from .sources import bigann, staging

K = 10
DIMS = 64
EPOCHS = 7

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "label")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every tenth vector."""
    return base(spark, sf_dir).where("key % 10 = 0").select(F.col("key").alias("query_id"), "vector")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    # adding 0 makes -0.0 the plain zero
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns or ("distance",)})


# ---------------------------------------------------------------- SQL pieces


def fold_sql(a: str, b: str, term: str) -> str:
    """Sum of term over x (of a) and y (of b), from the first dimension to the last."""
    term = term.replace("x", "CAST(z[1] AS DOUBLE)").replace("y", "CAST(z[2] AS DOUBLE)")
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda z: {term}), lambda s, v: s + v)"


def own_sql(a: str, term: str) -> str:
    term = term.replace("x", "CAST(z AS DOUBLE)")
    return f"list_reduce(list_transform({a}, lambda z: {term}), lambda s, v: s + v)"


def l2_sql(a="q.vector", b="b.vector"):
    return fold_sql(a, b, "(x - y) * (x - y)")


def half_sql(a, b):
    t = "CASE WHEN x > 0 THEN x * ln(CASE WHEN x > 0 THEN 2 * x / (x + y) ELSE 1 END) ELSE 0 END"
    return fold_sql(a, b, t)


A, B = "q.vector", "b.vector"
NORM = f"sqrt({own_sql(A, 'x * x')} * {own_sql(B, 'x * x')})"
_VX, _VY = (f"greatest({DIMS}.0::DOUBLE * {own_sql(v, 'x * x')} - {own_sql(v, 'x')} * {own_sql(v, 'x')}, 0.0::DOUBLE)" for v in (A, B))
_S = "sin((CAST(b.vector[1] AS DOUBLE) - CAST(q.vector[1] AS DOUBLE)) / 2)"
_T = "sin((CAST(b.vector[2] AS DOUBLE) - CAST(q.vector[2] AS DOUBLE)) / 2)"
DISTANCE_SQL = {
    "l2": l2_sql(),
    "ip": f"1.0::DOUBLE - {fold_sql(A, B, 'x * y')}",
    "cos": f"1.0::DOUBLE - {fold_sql(A, B, 'x * y')} / {NORM}",
    "manhattan": fold_sql(A, B, "abs(x - y)"),
    "pearson": f"1.0::DOUBLE - ({DIMS}.0::DOUBLE * {fold_sql(A, B, 'x * y')} - {own_sql(A, 'x')} * {own_sql(B, 'x')}) / sqrt({_VX} * {_VY})",
    "haversine": f"2.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt({_S} * {_S} + cos(CAST(q.vector[1] AS DOUBLE)) * cos(CAST(b.vector[1] AS DOUBLE)) * {_T} * {_T})))",
    "divergence": f"0.5::DOUBLE * {half_sql(A, B)} + 0.5::DOUBLE * {half_sql(B, A)}",
}
SIGN_SQL = "list_reduce(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN CASE WHEN i = 64 THEN -9223372036854775808 ELSE (1::BIGINT << (i - 1)::BIGINT) END ELSE 0::BIGINT END), lambda s, v: s | v)"
_AND, _OR = "CAST(bit_count(q.word & b.word) AS BIGINT)", "CAST(bit_count(q.word | b.word) AS BIGINT)"
BIT_SQL = {
    "hamming": "CAST(bit_count(xor(q.word, b.word)) AS DOUBLE)",
    "jaccard": f"CASE WHEN {_OR} = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - {_AND} / CAST({_OR} AS DOUBLE) END",
    "sorensen": f"CASE WHEN bit_count(q.word) + bit_count(b.word) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - 2 * {_AND} / CAST(CAST(bit_count(q.word) AS BIGINT) + CAST(bit_count(b.word) AS BIGINT) AS DOUBLE) END",
}


def with_sql(vector: str = "embedding", queries: str = "vec_id % 10 = 0", where: str = "true") -> str:
    return f"""WITH base AS (SELECT vec_id AS key, {vector} AS vector, {SIGN_SQL} AS word, label FROM embeddings),
    b AS (SELECT * FROM base WHERE {where}), q AS (SELECT vec_id AS query_id, {vector} AS vector, {SIGN_SQL} AS word FROM embeddings WHERE {queries})"""


def knn_sql(distance: str, vector: str = "embedding", where: str = "true", k: int = K, name: str = "r") -> str:
    """CTEs that end with a table `name` of query_id, rank, key, distance."""
    return f"""{with_sql(vector, where=where)},
    d AS (SELECT q.query_id, b.key, {distance} AS distance FROM q, b),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) AS rank FROM d),
    {name} AS (SELECT query_id, rank, key, distance FROM ranked WHERE rank <= {k})"""


ROWS = "SELECT query_id, rank, key, round(distance, 6) + 0.0::DOUBLE AS distance FROM r"

# ---------------------------------------------------------------- exact search by metric


def _by_metric(name: str):
    def run(spark, sf_dir):
        b, q = base(spark, sf_dir), asked(spark, sf_dir)
        if name == "divergence":  # defined for what is not negative
            b, q = (x.withColumn("vector", F.transform("vector", lambda v: F.abs(v))) for x in (b, q))
        return rounded(knn(b, q, K, name))

    return run


for _name, _sql in DISTANCE_SQL.items():
    _v = "list_transform(embedding, lambda x: abs(x))" if _name == "divergence" else "embedding"
    query(f"knn_{_name}", f"{knn_sql(_sql, _v)} {ROWS}")(_by_metric(_name))


def words(df: DataFrame) -> DataFrame:
    return df.withColumn("vector", quantize.sign_words(F.col("vector"), DIMS))


def _by_bits(name: str):
    return lambda spark, sf_dir: rounded(knn(words(base(spark, sf_dir)), words(asked(spark, sf_dir)), K, name))


for _name, _sql in BIT_SQL.items():
    query(f"knn_{_name}", f"{knn_sql(_sql)} {ROWS}")(_by_bits(_name))


@query("knn_l2_join", f"{knn_sql(DISTANCE_SQL['l2'])} {ROWS}")
def knn_l2_join(spark, sf_dir):
    return rounded(knn_join(base(spark, sf_dir), asked(spark, sf_dir), K))


def views(spark, sf_dir, bits: bool = False) -> tuple[str, str]:
    """Names of views of the base and the stated queries, for statements in SQL."""
    names = ("base_words", "asked_words") if bits else ("base_vectors", "asked_vectors")
    for name, df in zip(names, (base(spark, sf_dir), asked(spark, sf_dir)), strict=True):
        (words(df) if bits else df).createOrReplaceTempView(name)
    return names


@query("knn_table_function", f"{knn_sql(DISTANCE_SQL['cos'])} {ROWS}")
def knn_table_function(spark, sf_dir):
    sql.register(spark)
    return rounded(spark.sql(sql.nearest_sql(*views(spark, sf_dir), K, "cos", base_blocks=4, query_blocks=2)))


@query("distances_by_sql_functions", f"""{knn_sql(DISTANCE_SQL['l2'])} SELECT r.query_id, r.key, {", ".join(f"round({DISTANCE_SQL[m]}, 6) + 0.0::DOUBLE AS {m}" for m in ('ip', 'cos', 'manhattan', 'pearson', 'haversine'))},
    {", ".join(f"round({x}, 6) AS {m}" for m, x in BIT_SQL.items())} FROM r JOIN q ON q.query_id = r.query_id JOIN b ON b.key = r.key""")
def distances_by_sql_functions(spark, sf_dir):
    """Other distances of the nearest by l2, all in one SQL statement."""
    sql.register(spark)
    (b, q), (bw, qw) = views(spark, sf_dir), views(spark, sf_dir, bits=True)
    each = ", ".join(f"round({m}_distance({x}.vector, {y}.vector), 6) + 0D AS {m}" for m, x, y in [(m, "q", "b") for m in ("ip", "cos", "manhattan", "pearson", "haversine")] + [(m, "qw", "bw") for m in BIT_SQL])
    return spark.sql(f"""WITH r AS ({sql.nearest_sql(b, q, K, base_blocks=4)}) SELECT r.query_id, r.key, {each} FROM r
        JOIN {q} q ON q.query_id = r.query_id JOIN {b} b ON b.key = r.key JOIN {qw} qw ON qw.query_id = r.query_id JOIN {bw} bw ON bw.key = r.key""")


@query("knn_truncated_dims", f"{knn_sql(DISTANCE_SQL['l2'], 'embedding[1:16]')} {ROWS}")
def knn_truncated_dims(spark, sf_dir):
    d = quantize.check_dims(16, DIMS)
    b, q = (x.withColumn("vector", quantize.truncated(F.col("vector"), d)) for x in (base(spark, sf_dir), asked(spark, sf_dir)))
    return rounded(knn(b, q, K))


@query("truncation_sweep", " UNION ALL ".join(f"SELECT {d}::BIGINT AS dims, * FROM ({knn_sql(DISTANCE_SQL['l2'], f'embedding[1:{d}]')} {ROWS})" for d in (8, 16, 32, 64)))
def truncation_sweep(spark, sf_dir):
    out = None
    for d in (8, 16, 32, 64):
        b, q = (x.withColumn("vector", quantize.truncated(F.col("vector"), d)) for x in (base(spark, sf_dir), asked(spark, sf_dir)))
        part = rounded(knn(b, q, K)).withColumn("dims", F.lit(d).cast("bigint"))
        out = part if out is None else out.unionByName(part)
    return out


@query("knn_sharded_merge", f"{knn_sql(DISTANCE_SQL['l2'])} {ROWS}")
def knn_sharded_merge(spark, sf_dir):
    sharded = base(spark, sf_dir).withColumn("shard", sampling.shard_of(F.col("key"), 4))
    return rounded(merge_shards(knn(sharded, asked(spark, sf_dir), K, by="shard"), K))


@query("knn_filtered_label", f"{knn_sql(DISTANCE_SQL['l2'], where='label = 3')} {ROWS}")
def knn_filtered_label(spark, sf_dir):
    return rounded(knn(base(spark, sf_dir).where("label = 3"), asked(spark, sf_dir), K))


INTEGER_SQL = {
    "i8": "list_transform(embedding, lambda v: trunc(greatest(least(CAST(v AS DOUBLE) * 127, 127), -128)))",
    "u8": "list_transform(embedding, lambda v: trunc(greatest(least(CAST(v AS DOUBLE) * 255, 255), 0)))",
}


def _by_integer(name: str, scale: float):
    def run(spark, sf_dir):
        b, q = (x.withColumn("vector", quantize.to_integer(F.col("vector"), name, scale)) for x in (base(spark, sf_dir), asked(spark, sf_dir)))
        return rounded(knn(b, q, K))

    return run


for _name, _scale in (("i8", 127.0), ("u8", 255.0)):
    query(f"knn_{_name}", f"{knn_sql(DISTANCE_SQL['l2'], INTEGER_SQL[_name])} {ROWS}")(_by_integer(_name, _scale))


@query(
    "knn_binary_rerank",
    f"""{knn_sql(BIT_SQL['hamming'], k=4 * K, name='short')},
    s AS (SELECT short.query_id, short.key, {l2_sql()} AS distance FROM short JOIN q ON q.query_id = short.query_id JOIN b ON b.key = short.key),
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) AS rank FROM s) WHERE rank <= {K}) {ROWS}""",
)
def knn_binary_rerank(spark, sf_dir):
    b, q = base(spark, sf_dir), asked(spark, sf_dir)
    short = knn(words(b), words(q), 4 * K, "hamming")
    return rounded(rerank(short, b.select("key", "vector"), q, K))


CUT = (1 - 0.99) / 2
SCALAR_SQL = f"""{with_sql()}, e AS (SELECT vec_id, unnest(range(0, {DIMS})) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
    bounds AS (SELECT dim, quantile_disc(x, {CUT}) AS low, quantile_disc(x, {1 - CUT}) AS high FROM e GROUP BY dim),
    codes AS (SELECT vec_id, list(trunc(greatest(0, least(255, (x - low) / (high - low) * 255)))::DOUBLE ORDER BY dim) AS code FROM e JOIN bounds USING (dim) GROUP BY vec_id),
    d AS (SELECT x.vec_id AS query_id, y.vec_id AS key, {fold_sql('x.code', 'y.code', '(x - y) * (x - y)')} AS distance FROM codes x, codes y WHERE x.vec_id % 10 = 0),
    short AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) AS n FROM d) WHERE n <= {4 * K}),
    s AS (SELECT short.query_id, short.key, {l2_sql()} AS distance FROM short JOIN q ON q.query_id = short.query_id JOIN b ON b.key = short.key),
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) AS rank FROM s) WHERE rank <= {K})"""


@query("knn_scalar_quant", f"{SCALAR_SQL} {ROWS}")
def knn_scalar_quant(spark, sf_dir):
    """Codes between the bounds that hold 0.99 of each dimension, then exact distances of the best 4 K."""
    b, q = base(spark, sf_dir).select("key", "vector"), asked(spark, sf_dir)
    bounds = quantize.dim_bounds(b, "vector", 0.99)
    short = knn(quantize.scalar_codes(b, "vector", bounds), quantize.scalar_codes(q, "vector", bounds), 4 * K)
    return rounded(rerank(short, b, q, K))


@query("knn_bounds_scan", f"{knn_sql(DISTANCE_SQL['l2'])} {ROWS}")
def knn_bounds_scan(spark, sf_dir):
    """Codes of one byte a dimension bound every distance; only rows that may be among the nearest are fetched."""
    index = BoundsIndex("l2")
    index.add(base(spark, sf_dir).select("key", "vector"))
    return rounded(index.search(asked(spark, sf_dir), K))


@query("scalar_codes", f"""WITH e AS (SELECT vec_id, unnest(range(0, {DIMS})) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
    bounds AS (SELECT dim, min(x) AS low, max(x) AS high FROM e GROUP BY dim)
    SELECT vec_id AS key, dim, CAST(trunc(greatest(0, least(255, (x - low) / (high - low) * 255))) AS BIGINT) AS code FROM e JOIN bounds USING (dim)""")
def scalar_codes(spark, sf_dir):
    b = base(spark, sf_dir).select("key", "vector")
    coded = quantize.scalar_codes(b, "vector", quantize.dim_bounds(b, "vector"))
    return coded.select("key", F.posexplode("vector").alias("dim", "code")).select("key", F.col("dim").cast("bigint").alias("dim"), F.col("code").cast("bigint").alias("code"))


@query("knn_radius_count", f"""{with_sql()}, d AS (SELECT q.query_id, {l2_sql()} AS distance FROM q, b)
    SELECT query_id, count(*) FILTER (WHERE distance <= 1.5) AS within FROM d GROUP BY query_id""")
def knn_radius_count(spark, sf_dir):
    return radius_count(base(spark, sf_dir), asked(spark, sf_dir), 1.5)


@query("label_vote", f"""{knn_sql(DISTANCE_SQL['l2'])}, v AS (SELECT r.query_id, b.label, count(*) AS votes, min(r.rank) AS best FROM r JOIN b ON b.key = r.key GROUP BY r.query_id, b.label)
    SELECT query_id, label, votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, best) AS n FROM v) WHERE n = 1""")
def label_vote(spark, sf_dir):
    b = base(spark, sf_dir)
    votes = knn(b, asked(spark, sf_dir), K).join(b.select("key", "label"), "key").groupBy("query_id", "label").agg(F.count("*").alias("votes"), F.min("rank").alias("best"))
    w = Window.partitionBy("query_id").orderBy(F.desc("votes"), "best")
    return votes.withColumn("n", F.row_number().over(w)).where("n = 1").select("query_id", "label", "votes")


# ---------------------------------------------------------------- evaluation

#: Ground truth is exact; what is evaluated are results at 16 of 64 dimensions.
TRUTH_SQL = f"truth AS (SELECT * FROM ({knn_sql(DISTANCE_SQL['l2'])} SELECT query_id, rank, key FROM r)), results AS (SELECT * FROM ({knn_sql(DISTANCE_SQL['l2'], 'embedding[1:16]')} SELECT query_id, rank, key FROM r))"


def judged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return knn_truncated_dims(spark, sf_dir).drop("distance"), knn(base(spark, sf_dir), asked(spark, sf_dir), K).drop("distance")


def recall_sql(k: int) -> str:
    return f"SELECT round(avg(hit), 9) AS recall FROM (SELECT results.query_id, max(CASE WHEN results.key = t.key AND results.rank <= {k} THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit FROM results LEFT JOIN truth t ON t.query_id = results.query_id AND t.rank = 1 GROUP BY results.query_id)"


NDCG_SQL = f"""SELECT round(avg(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, {K + 1}) t(i))), 6) AS ndcg FROM (
    SELECT results.query_id, sum(CASE WHEN t.key IS NOT NULL THEN 1 / log2(results.rank + 1) ELSE 0 END) AS dcg
    FROM results LEFT JOIN truth t ON t.query_id = results.query_id AND t.key = results.key WHERE results.rank <= {K} GROUP BY results.query_id)"""


@query("recall_at_1", f"WITH {TRUTH_SQL} {recall_sql(1)}")
def recall_at_1(spark, sf_dir):
    return rounded(evaluate.recall(*judged(spark, sf_dir), 1), "recall", digits=9)


@query("recall_at_10", f"WITH {TRUTH_SQL} {recall_sql(10)}")
def recall_at_10(spark, sf_dir):
    return rounded(evaluate.recall(*judged(spark, sf_dir), 10), "recall", digits=9)


@query("ndcg_at_10", f"WITH {TRUTH_SQL} {NDCG_SQL}")
def ndcg_at_10(spark, sf_dir):
    return rounded(evaluate.ndcg(*judged(spark, sf_dir), K), "ndcg")


#: A backend that leaves queries unanswered: results beyond this squared distance are dropped, and the base has no queries.
RADIUS = 1.2
PARTLY_SQL = f"""{knn_sql(DISTANCE_SQL['l2'], where='key % 10 <> 0')}, truth AS (SELECT query_id, rank, key FROM r), results AS (SELECT query_id, rank, key FROM r WHERE distance <= {RADIUS})"""


def partly(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    found = knn(base(spark, sf_dir).where("key % 10 <> 0"), asked(spark, sf_dir), K)
    return found.where(F.col("distance") <= RADIUS).drop("distance"), found.drop("distance")


@query("recall_unanswered", f"{PARTLY_SQL} SELECT round(count(results.key)::DOUBLE / count(*), 9) AS recall FROM truth LEFT JOIN results ON results.query_id = truth.query_id AND results.key = truth.key WHERE truth.rank = 1")
def recall_unanswered(spark, sf_dir):
    return rounded(evaluate.recall(*partly(spark, sf_dir), K, queries=asked(spark, sf_dir)), "recall", digits=9)


@query("ndcg_unanswered", f"""{PARTLY_SQL} SELECT round(sum(dcg) / count(*), 6) AS ndcg FROM (SELECT q.query_id, coalesce(sum(1 / log2(results.rank + 1)), 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, {K + 1}) t(i)) AS dcg
    FROM q LEFT JOIN results ON results.query_id = q.query_id GROUP BY q.query_id)""")
def ndcg_unanswered(spark, sf_dir):
    return rounded(evaluate.ndcg(*partly(spark, sf_dir), K, queries=asked(spark, sf_dir)), "ndcg")


def curve(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    b = base(spark, sf_dir).select(F.col("key").alias("row"), "key", "vector")
    total = b.count()
    return bench.epoch_curve(b, asked(spark, sf_dir), K, EPOCHS, total), b.agg(F.count("*").alias("total"))


STEPS_SQL = f"""{with_sql()}, total AS (SELECT count(*) AS total, CAST(ceil(count(*) / {EPOCHS}.0) AS BIGINT) AS step_rows FROM embeddings),
    d AS (SELECT q.query_id, b.key, {l2_sql()} AS distance FROM q, b),
    s AS (SELECT t.step, d.*, row_number() OVER (PARTITION BY t.step, query_id ORDER BY distance, key) AS rank FROM d, total, (SELECT unnest(range(0, {EPOCHS})) AS step) t WHERE d.key < (t.step + 1) * step_rows),
    steps AS (SELECT * FROM s WHERE rank <= {K}), truth AS (SELECT query_id, key FROM steps WHERE step = {EPOCHS - 1} AND rank = 1),
    each AS (SELECT step, steps.query_id, max(CASE WHEN steps.key = truth.key THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit FROM steps LEFT JOIN truth ON truth.query_id = steps.query_id GROUP BY step, steps.query_id)"""


@query("epoch_topk", f"{STEPS_SQL} SELECT step::BIGINT AS step, query_id, rank, key, round(distance, 6) AS distance FROM steps")
def epoch_topk(spark, sf_dir):
    return rounded(curve(spark, sf_dir)[0])


@query("epoch_recall_curve", f"{STEPS_SQL} SELECT step::BIGINT AS step, round(avg(hit), 9) AS recall FROM each GROUP BY step")
def epoch_recall_curve(spark, sf_dir):
    steps, _ = curve(spark, sf_dir)
    truth = knn(base(spark, sf_dir), asked(spark, sf_dir), K)
    return rounded(evaluate.recall(steps, truth, K, "step"), "recall", digits=9)


STEPS = 3
RUN_SQL = f"""{knn_sql(DISTANCE_SQL['l2'], k=1)}, n AS (SELECT count(*) AS total, CAST(ceil(count(*) / {STEPS}.0) AS BIGINT) AS s FROM embeddings),
    p AS (SELECT vec_id, row_number() OVER (ORDER BY {sampling.row_hash_sql('vec_id')}, vec_id) - 1 AS perm FROM embeddings),
    e AS (SELECT t.step, least((t.step + 1) * s, total) AS indexed, least((t.step + 1) * s, total) - least(t.step * s, total) AS added FROM n, (SELECT unnest(range(0, {STEPS})) AS step) t)
    SELECT e.step::BIGINT AS step, indexed::BIGINT AS vectors_indexed, added::BIGINT AS rows_added, (count(*) * least({K}, indexed))::BIGINT AS rows_found, round(avg(CASE WHEN p.perm < indexed THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS recall_at_10
    FROM e, r JOIN p ON p.vec_id = r.key GROUP BY e.step, indexed, added"""


@query("observed_run", RUN_SQL)
def observed_run(spark, sf_dir):
    """A whole run over the table in shuffled order: what plans have seen of rows in each step, and its recall."""
    b = base(spark, sf_dir).select(F.col("key").alias("row"), "vector")
    q = asked(spark, sf_dir)
    truth = knn(b.withColumnRenamed("row", "key"), q, K).drop("distance")
    steps = bench.run(bench.BenchSpec(b, q, truth, K, epochs=STEPS), FlatIndex())
    rows = [(i, s["vectors_indexed"], s["rows_added"], s["rows_found"], s["recall_at_10"]) for i, s in enumerate(steps)]  # one a step
    return rounded(spark.createDataFrame(rows, "step bigint, vectors_indexed bigint, rows_added bigint, rows_found bigint, recall_at_10 double"), "recall_at_10", digits=9)


@query("normalized_metrics", f"""{STEPS_SQL}, raw AS (SELECT step, avg(hit) AS recall FROM each GROUP BY step)
    SELECT step::BIGINT AS step, CAST(least((step + 1) * step_rows, total) AS BIGINT) AS indexed, round(least(recall / (least((step + 1) * step_rows, total)::DOUBLE / total), 1.0), 6) AS normalized FROM raw, total""")
def normalized_metrics(spark, sf_dir):
    total = base(spark, sf_dir).count()
    sizes = spark.createDataFrame([(e, first + n) for e, first, n in bench.sampling.epoch_sizes(total, EPOCHS)], "step bigint, indexed bigint")
    raw = evaluate.recall(curve(spark, sf_dir)[0], knn(base(spark, sf_dir), asked(spark, sf_dir), K), K, "step")
    joined = raw.join(F.broadcast(sizes), "step")
    return joined.select("step", "indexed", F.round(evaluate.normalized(F.col("recall"), F.col("indexed"), F.lit(total)), 6).alias("normalized"))


@query("found_counts", f"{PARTLY_SQL} SELECT query_id, count(*) AS found FROM results GROUP BY query_id")
def found_counts(spark, sf_dir):
    return evaluate.found_counts(partly(spark, sf_dir)[0])


@query("padded_results", f"""{PARTLY_SQL}, slots AS (SELECT query_id, unnest(range(1, {K + 1})) AS rank FROM q)
    SELECT slots.query_id, slots.rank, coalesce(key, 4294967295) AS key, key IS NOT NULL AS filled FROM slots LEFT JOIN results r ON r.query_id = slots.query_id AND r.rank = slots.rank""")
def padded_results(spark, sf_dir):
    q = asked(spark, sf_dir)
    found = partly(spark, sf_dir)[0].withColumn("distance", F.lit(0.0))
    return padded(found, q, K).select("query_id", "rank", "key", (F.col("distance") < float("inf")).alias("filled"))


@query("translated_keys", f"""{knn_sql(DISTANCE_SQL['l2'])} SELECT query_id, rank, CASE WHEN key % 5 = 0 THEN 4294967295 ELSE key * 7 + 1 END AS key FROM r""")
def translated_keys(spark, sf_dir):
    b = base(spark, sf_dir)
    labels = b.where("key % 5 <> 0").select(F.col("key").alias("label"), (F.col("key") * 7 + 1).alias("user_key"))
    return translate_labels(knn(b, asked(spark, sf_dir), K), labels).drop("distance")


@query("ground_truth_table", f"{knn_sql(DISTANCE_SQL['l2'])} SELECT query_id, rank, key FROM r")
def ground_truth_table(spark, sf_dir):
    wide = knn(base(spark, sf_dir), asked(spark, sf_dir), K).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "key"))), lambda s: s["key"]).alias("neighbors"))
    return evaluate.truth_table(wide)


@query("result_membership", f"WITH {TRUTH_SQL} SELECT results.query_id, results.rank, results.key, truth.rank AS true_rank FROM results LEFT JOIN truth ON truth.query_id = results.query_id AND truth.key = results.key")
def result_membership(spark, sf_dir):
    results, truth = judged(spark, sf_dir)
    return evaluate.membership(results, truth).select("query_id", "rank", "key", "true_rank")


# ---------------------------------------------------------------- order, samples, shards

HASH_SQL = sampling.row_hash_sql("vec_id")


@query("insertion_order", f"SELECT vec_id AS row, row_number() OVER (ORDER BY {HASH_SQL}, vec_id) - 1 AS perm FROM embeddings")
def insertion_order(spark, sf_dir):
    return sampling.insertion_order(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"))).select("row", "perm")


@query("permuted_rows", sampling.permutation_sql("embeddings", "vec_id"))
def permuted_rows(spark, sf_dir):
    """Each row's place in a keyed permutation of all rows, and the row that the place leads back to."""
    rows = base(spark, sf_dir)
    n = rows.count()
    placed = rows.select(F.col("key").alias("row"), sampling.permuted(F.col("key"), n).alias("place"))
    return placed.select("row", "place", sampling.unpermuted(F.col("place"), n).alias("back"))


@query("sample_queries", f"SELECT vec_id AS row FROM embeddings ORDER BY {HASH_SQL}, vec_id LIMIT 50")
def sample_queries(spark, sf_dir):
    return sampling.sample(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row")), 50)


@query("epoch_sizes", f"""WITH n AS (SELECT count(*) AS n, CAST(ceil(count(*) / {EPOCHS}.0) AS BIGINT) AS s FROM embeddings)
    SELECT e::BIGINT AS epoch, least(e * s, n)::BIGINT AS first, greatest(0, least(s, n - e * s))::BIGINT AS rows FROM n, (SELECT unnest(range(0, {EPOCHS})) AS e)""")
def epoch_sizes(spark, sf_dir):
    return spark.createDataFrame(sampling.epoch_sizes(base(spark, sf_dir).count(), EPOCHS), "epoch bigint, first bigint, rows bigint")


@query("shard_assignment", "SELECT vec_id AS key, vec_id % 4 AS shard FROM embeddings")
def shard_assignment(spark, sf_dir):
    return base(spark, sf_dir).select("key", sampling.shard_of(F.col("key"), 4).alias("shard"))


@query("shard_offsets", """WITH s AS (SELECT label::BIGINT AS shard, count(*) AS rows FROM embeddings GROUP BY label)
    SELECT shard, rows, CAST(coalesce(sum(rows) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM s""")
def shard_offsets(spark, sf_dir):
    return sampling.shard_offsets(base(spark, sf_dir).groupBy(F.col("label").cast("bigint").alias("shard")).agg(F.count("*").alias("rows")))


@query("located_rows", """WITH s AS (SELECT label::BIGINT AS shard, count(*) AS rows FROM embeddings GROUP BY label),
    o AS (SELECT shard, rows, coalesce(sum(rows) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s)
    SELECT vec_id AS row, shard, CAST(vec_id - off AS BIGINT) AS local FROM embeddings JOIN o ON vec_id >= off AND vec_id < off + rows""")
def located_rows(spark, sf_dir):
    return sampling.locate(base(spark, sf_dir).select(F.col("key").alias("row")), shard_offsets(spark, sf_dir))


@query("row_slice", "SELECT vec_id AS row, CAST(embedding[1] AS DOUBLE) AS first_value FROM embeddings WHERE vec_id >= 100 AND vec_id < 150")
def row_slice(spark, sf_dir):
    return sampling.sliced(table(spark, sf_dir, "embeddings"), 100, 150, "vec_id").select(F.col("vec_id").alias("row"), F.col("embedding")[0].cast("double").alias("first_value"))


@query("row_cap", "SELECT count(*) AS rows FROM embeddings WHERE vec_id < 300")
def row_cap(spark, sf_dir):
    return sampling.capped(table(spark, sf_dir, "embeddings"), 300, "vec_id").agg(F.count("*").alias("rows"))


# ---------------------------------------------------------------- representations


@query("sign_codes", f"SELECT vec_id AS key, {SIGN_SQL} AS word FROM embeddings")
def sign_codes(spark, sf_dir):
    return words(base(spark, sf_dir)).select("key", F.col("vector")[0].alias("word"))


def _exploded(name: str, scale: float):
    return lambda spark, sf_dir: base(spark, sf_dir).select("key", F.posexplode(quantize.to_integer(F.col("vector"), name, scale)).alias("dim", "value")).select("key", F.col("dim").cast("bigint").alias("dim"), F.col("value").cast("bigint").alias("value"))


for _name, _scale in (("i8", 127.0), ("u8", 255.0)):
    query(f"{_name}_vectors", f"SELECT vec_id AS key, unnest(range(0, {DIMS})) AS dim, CAST(unnest({INTEGER_SQL[_name]}) AS BIGINT) AS value FROM embeddings")(_exploded(_name, _scale))


@query("widened_vectors", f"SELECT vec_id AS key, unnest(range(0, {DIMS})) AS dim, CAST(unnest({INTEGER_SQL['i8']}) AS DOUBLE) AS value FROM embeddings")
def widened_vectors(spark, sf_dir):
    wide = quantize.widened(quantize.to_integer(F.col("vector"), "i8", 127.0))
    return base(spark, sf_dir).select("key", F.posexplode(wide).alias("dim", "value")).select("key", F.col("dim").cast("bigint").alias("dim"), F.col("value").cast("double").alias("value"))


CASTS = {"f64": "v::DOUBLE", "f32": "v::DOUBLE", "i8": "trunc(greatest(least(v::DOUBLE, 127), -128))", "u8": "trunc(greatest(least(v::DOUBLE, 255), 0))"} | {t: quantize.rounded_sql("v", t) for t in ("f16", "bf16", "e4m3", "e5m2", "e3m2", "e2m3")}


@query("wire_casts", " UNION ALL ".join(f"SELECT '{t}' AS type, event_id, round(({x})::DOUBLE, 9) + 0.0::DOUBLE AS stored FROM (SELECT event_id, value::FLOAT AS v FROM events)" for t, x in CASTS.items()))
def wire_casts(spark, sf_dir):
    """Values of every type that goes over a wire, from 32-bit floats."""
    one = table(spark, sf_dir, "events").select("event_id", F.array(F.col("value").cast("float")).alias("v"))
    out = None
    for t in CASTS:
        part = one.select(F.lit(t).alias("type"), "event_id", (F.round(quantize.cast(F.col("v"), t)[0].cast("double"), 9) + F.lit(0.0)).alias("stored"))
        out = part if out is None else out.unionByName(part)
    return out


def sizes(spark, sf_dir) -> DataFrame:
    """One row: how many vectors there are, and how many values in all."""
    return base(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(F.size("vector")).cast("bigint").alias("total"))


SIZES_SQL = "(SELECT count(*) AS n, sum(len(embedding))::BIGINT AS total FROM embeddings)"


@query("data_types", f"SELECT type, bits, wire, total * bits // 8 AS table_bytes FROM (VALUES ('f64', 64, 'FLOAT64'), ('f32', 32, 'FLOAT32'), ('bf16', 16, 'BFLOAT16'), ('f16', 16, 'FLOAT16'), ('e5m2', 8, NULL), ('e4m3', 8, NULL), ('e3m2', 6, NULL), ('e2m3', 6, NULL), ('i8', 8, 'INT8'), ('u8', 8, 'UINT8'), ('b1', 1, NULL)) t(type, bits, wire), {SIZES_SQL} s")
def data_types(spark, sf_dir):
    """What the table's vectors take in each element type."""
    types = spark.createDataFrame([(quantize.data_type(t), *x) for t, x in quantize.TYPES.items()], "type string, bits int, wire string")
    return sizes(spark, sf_dir).crossJoin(F.broadcast(types)).select("type", "bits", "wire", F.expr("total * bits div 8").alias("table_bytes"))  # a row a type


@query("sequential_keys", "SELECT vec_id AS row, vec_id AS key FROM embeddings WHERE vec_id >= 20 AND vec_id < 40")
def sequential_keys(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").count()
    return sampling.sliced(spark.range(n).select(F.col("id").alias("row"), F.col("id").alias("key")), 20, 40)


@query("dim_bounds", f"SELECT dim, min(x) AS low, max(x) AS high FROM (SELECT unnest(range(0, {DIMS})) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY dim")
def dim_bounds(spark, sf_dir):
    return quantize.dim_bounds(base(spark, sf_dir), "vector").withColumn("dim", F.col("dim").cast("bigint"))


@query("memory_estimate", f"SELECT label, count(*) * ({DIMS} * 4 + 8 + 32 * 4) AS memory_bytes FROM embeddings GROUP BY label")
def memory_estimate(spark, sf_dir):
    return base(spark, sf_dir).groupBy("label").agg(F.sum(memory_bytes(F.size("vector"), 16)).alias("memory_bytes"))


@query("config_grid", f"SELECT c::BIGINT AS connectivity, e::BIGINT AS expansion, t.type AS data_type, total * bits // 8 + n * (8 + 8 * c) AS memory_bytes FROM (SELECT unnest([16, 32, 48]) AS c), (SELECT unnest([64, 128]) AS e), (VALUES ('f32', 32), ('i8', 8), ('b1', 1)) t(type, bits), {SIZES_SQL} s")
def config_grid(spark, sf_dir):
    """The configurations of a sweep, and what an index over the table takes in each."""
    rows = [(g["connectivity"], g["expansion"], g["data_type"], quantize.TYPES[g["data_type"]][0]) for g in bench.grid(connectivity=[16, 32, 48], expansion=[64, 128], data_type=["f32", "i8", "b1"])]
    each = spark.createDataFrame(rows, "connectivity bigint, expansion bigint, data_type string, bits int")
    memory = F.expr("total * bits div 8 + n * (8 + 8 * connectivity)").alias("memory_bytes")
    return sizes(spark, sf_dir).crossJoin(F.broadcast(each)).select("connectivity", "expansion", "data_type", memory)  # a row a configuration


# ---------------------------------------------------------------- text and numbers


@query("text_lines_escaped", r"""SELECT doc_id, replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r') AS line FROM documents""")
def text_lines_escaped(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.escaped_line(F.col("text")).alias("line"))


@query("natural_sort", "SELECT DISTINCT source AS name, CAST(substr(source, 4) AS BIGINT) AS number, dense_rank() OVER (ORDER BY CAST(substr(source, 4) AS BIGINT)) AS place FROM documents")
def natural_sort(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()  # one row a source
    w = Window.orderBy(text.natural_order(F.col("name")))
    return names.select("name", F.substring("name", 4, 20).cast("bigint").alias("number"), F.row_number().over(w).cast("bigint").alias("place"))


@query("series_labels", """WITH c AS (SELECT event_type AS backend, CASE WHEN user_id % 4 <> 0 THEN 'f32' END AS dtype, 'l2' AS metric, CASE WHEN user_id % 3 <> 0 THEN 16 * (user_id % 3) END AS m,
    CASE WHEN user_id % 5 <> 0 THEN 128 END AS a, CASE WHEN user_id % 2 = 0 THEN 64 END AS s, user_id % 3 AS shards FROM events)
    SELECT DISTINCT concat_ws(' · ', backend, dtype, metric, 'M=' || m, 'ef=' || a || '/' || s, CASE WHEN shards > 1 THEN shards || 's' END) AS label FROM c""")
def series_labels(spark, sf_dir):
    """Names of series for configurations with parts left out here and there."""
    user, some = F.col("user_id"), lambda c, v: F.when(c, v)
    parts = [some(user % 4 != 0, F.lit("f32")), F.lit("l2"), some(user % 3 != 0, 16 * (user % 3)), some(user % 5 != 0, F.lit(128)), some(user % 2 == 0, F.lit(64)), user % 3]
    return table(spark, sf_dir, "events").select(text.config_label(F.col("event_type"), *parts).alias("label")).distinct()


@query("throughput", "SELECT event_id, CASE WHEN value = 0 THEN 0 ELSE CAST(floor(1000 / value) AS BIGINT) END AS per_second FROM events")
def throughput(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.throughput(F.lit(1000), F.col("value")).alias("per_second"))


@query("thousands", "SELECT event_id, format('{:,}', event_id * 12345) AS shown FROM events")
def thousands(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.thousands(F.col("event_id") * 12345).alias("shown"))


@query("shard_files", "SELECT DISTINCT printf('%010d-%010d.parquet', (vec_id // 100) * 100, (vec_id // 100) * 100 + 99) AS file FROM embeddings")
def shard_files(spark, sf_dir):
    first = (F.floor(F.col("vec_id") / 100) * 100).cast("bigint")
    return table(spark, sf_dir, "embeddings").select(text.shard_file(first, first + 99).alias("file")).distinct()


@query("stored_keys", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 4294967295 ELSE event_id END AS key FROM events")
def stored_keys(spark, sf_dir):
    name = F.when(F.col("event_id") % 3 == 0, F.lit("vec:none")).otherwise(F.concat(F.lit("vec:"), F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", text.stored_key(name, "vec:").alias("key"))


@query("counter_rates", "SELECT event_id, CAST(event_id AS DOUBLE) / greatest(event_id % 7, 1) AS rate FROM events")
def counter_rates(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", report.rate(F.col("event_id"), F.col("event_id") % 7).alias("rate"))


@query("outcome_counts", "SELECT event_type AS outcome, count(*) AS n FROM events GROUP BY event_type")
def outcome_counts(spark, sf_dir):
    return bench.counts_by(table(spark, sf_dir, "events"), "event_type")


@query("peak_value", "SELECT event_type, max(value) AS peak FROM events GROUP BY event_type")
def peak_value(spark, sf_dir):
    return report.peak_by(table(spark, sf_dir, "events"), "event_type", "value", "peak")


# ---------------------------------------------------------------- without SQL


def _by_precision(name: str):
    def run(spark, sf_dir):
        b, q = (x.withColumn("vector", quantize.at_precision(F.col("vector"), name)) for x in (base(spark, sf_dir), asked(spark, sf_dir)))
        return rounded(knn(b, q, K))

    return run


for _name in ("f16", "bf16", "e5m2", "e4m3", "e3m2", "e2m3"):
    _v = f"list_transform(embedding, lambda v: {quantize.rounded_sql('v', _name)})"
    query(f"knn_{_name}", f"{knn_sql(DISTANCE_SQL['l2'], _v)} {ROWS}")(_by_precision(_name))


def found_share(spark, sf_dir, index, name: str) -> DataFrame:
    """k, and whether a backend finds at least nine tenths of the k nearest."""
    index.add(base(spark, sf_dir))
    truth = knn(base(spark, sf_dir), asked(spark, sf_dir), K, name)
    hit = truth.select("query_id", "key").join(index.search(asked(spark, sf_dir), K).select("query_id", "key", F.lit(1).alias("hit")), ["query_id", "key"], "left")
    return hit.agg(F.lit(K).cast("bigint").alias("k"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@query("lsh_recall", f"SELECT {K}::BIGINT AS k, true AS enough")
def lsh_recall(spark, sf_dir):
    return found_share(spark, sf_dir, SignLsh(DIMS, "cos"), "cos")


@query("knn_hamming_indexed", f"{knn_sql(BIT_SQL['hamming'])} {ROWS}")
def knn_hamming_indexed(spark, sf_dir):
    return rounded(binary.hamming_index(words(base(spark, sf_dir)), words(asked(spark, sf_dir)), K, DIMS, 4)[0])


for _name in ("jaccard", "sorensen"):

    @query(f"knn_{_name}_bounded", f"{knn_sql(BIT_SQL[_name])} {ROWS}")
    def knn_bounded(spark, sf_dir, _name=_name):
        return rounded(binary.popcount_search(words(base(spark, sf_dir)), words(asked(spark, sf_dir)), K, _name)[0])


LISTS = 48  # more than 40 also where hashes give fewer


def graph_of(spark, sf_dir, **options) -> GraphIndex:
    """A graph over many lists, whatever the size of the table."""
    rows = base(spark, sf_dir)
    index = GraphIndex("l2", block_rows=max(1, rows.count() // LISTS), **options)
    index.add(rows)
    return index


@query("graph_recall")
def graph_recall(spark, sf_dir):
    """Lists, and the shares of the k nearest that a search finds and of the base that it compares."""
    index = graph_of(spark, sf_dir)
    truth, steps = knn(base(spark, sf_dir), asked(spark, sf_dir), K), staging.stage(index.trace(asked(spark, sf_dir), K))
    w = Window.partitionBy("query").orderBy("dist", "key")
    found = steps.where("kind = 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= K).select(F.col("query").alias("query_id"), "key", F.lit(1).alias("hit"))
    share = truth.join(found, ["query_id", "key"], "left").agg((F.count("hit") / F.count("*")).alias("found"))
    cost = steps.where("kind = 1").agg((F.sum("key") / F.countDistinct("query") / F.lit(base(spark, sf_dir).count())).alias("compared"))
    return share.crossJoin(cost).select(F.lit(len(index.centres)).cast("bigint").alias("lists"), "found", "compared")  # one row each


@query("graph_filtered_recall")
def graph_filtered_recall(spark, sf_dir):
    """For labels below 1, 3 and 6: rows that may be found, and the share of the k nearest of these that a filtered search finds."""
    index, rows, out = graph_of(spark, sf_dir), base(spark, sf_dir), None
    for most in (1, 3, 6):
        some = rows.where(F.col("label") < most)
        found = index.search(asked(spark, sf_dir), K, some).select("query_id", "key", F.lit(1).alias("hit"))
        part = knn(some, asked(spark, sf_dir), K).join(found, ["query_id", "key"], "left").agg((F.count("hit") / F.count("*")).alias("found"))
        part = part.select(F.lit(most).alias("below"), F.lit(some.count()).alias("rows"), "found")
        out = part if out is None else out.unionByName(part)
    return out


@query("descent_edges")
def descent_edges(spark, sf_dir):
    """How many of all edges to the true nearest neighbours descent finds from first edges inside lists."""
    index = graph_of(spark, sf_dir)
    rows = base(spark, sf_dir)
    truth = knn_grid(rows, rows.select(F.col("key").alias("query_id"), "vector"), K + 1).where("query_id <> key")
    met = truth.join(index.edges.select(F.col("node").alias("query_id"), F.col("nbr").alias("key"), F.lit(1).alias("hit")), ["query_id", "key"], "left")
    return met.agg(F.count("*").alias("edges"), (F.count("hit") / F.count("*")).alias("found"))


ALL_SQL = f"""WITH d AS (SELECT q.vec_id AS query_id, b.vec_id AS key, {fold_sql("q.embedding", "b.embedding", "(x - y) * (x - y)")} AS distance FROM embeddings q, embeddings b),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) AS rank FROM d)"""


@query("knn_all_rows", f"{ALL_SQL} SELECT query_id, rank, key, round(distance, 6) + 0.0::DOUBLE AS distance FROM ranked WHERE rank <= {K}")
def knn_all_rows(spark, sf_dir):
    rows = base(spark, sf_dir)
    return rounded(knn_grid(rows, rows.select(F.col("key").alias("query_id"), "vector"), K, cell_rows=max(64, rows.count() // 4)))


DETOUR_SQL = f"""{ALL_SQL}, e AS (SELECT query_id AS node, key AS nbr, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) - 1 AS rank FROM ranked WHERE rank <= {K} AND query_id <> key)
SELECT x.node, x.nbr, x.rank::INTEGER AS rank, count(z.nbr) AS ways FROM e x
LEFT JOIN (SELECT a.node, b.nbr, greatest(a.rank, b.rank) AS most FROM e a JOIN e b ON a.nbr = b.node) z ON z.node = x.node AND z.nbr = x.nbr AND z.most < x.rank
GROUP BY x.node, x.nbr, x.rank"""


@query("graph_detours", DETOUR_SQL)
def graph_detours(spark, sf_dir):
    """By how many pairs of shorter edges each edge of the exact neighbour graph can be replaced."""
    rows = base(spark, sf_dir)
    near = knn_grid(rows, rows.select(F.col("key").alias("query_id"), "vector"), K).where("query_id <> key")
    return detours(ranked_lists(near.select(F.col("query_id").alias("node"), F.col("key").alias("nbr"), F.col("distance").alias("dist"))))


@query("knn_lsh")
def knn_lsh(spark, sf_dir):
    index = SignLsh(DIMS, "cos")
    index.add(base(spark, sf_dir))
    return rounded(index.search(asked(spark, sf_dir), K))


@query("knn_graph")
def knn_graph(spark, sf_dir):
    index = GraphIndex("l2")
    index.add(base(spark, sf_dir))
    return rounded(index.search(asked(spark, sf_dir), K))


TWO64 = 1 << 64


def mixed_sql(row: str, column: str, seed: int, stream: int) -> str:
    """64 bits from a counter, as `generate.mixed`, in UHUGEINT arithmetic; a list is used to name each step once."""
    start = (seed * 0x2545F4914F6CDD1D + stream * 0xBF58476D1CE4E5B9) % TWO64

    def times(x: str, factor: int) -> str:
        return f"({x}::UHUGEINT * {factor}::UHUGEINT % {TWO64}::UHUGEINT)::UBIGINT"

    x = f"((({row})::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT + ({column})::UHUGEINT * {0xD1B54A32D192ED03}::UHUGEINT + {start}::UHUGEINT) % {TWO64}::UHUGEINT)::UBIGINT"
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = times(f"list_transform([{x}], lambda m: xor(m, m >> {shift}))[1]", factor)
    return f"list_transform([{x}], lambda m: xor(m, m >> 31))[1]"


def uniform_sql(row: str, column: str, seed: int, stream: int) -> str:
    return f"(({mixed_sql(row, column, seed, stream)} >> 11)::DOUBLE * {2.0**-53!r}::DOUBLE)"


@query("generate_gaussian", f"""WITH c AS (SELECT r::BIGINT AS row, j, {uniform_sql('r', 'j', 42, 0)} AS u, {uniform_sql('r', 'j', 42, 1)} AS v FROM (SELECT unnest(range((SELECT count(*) FROM embeddings))) AS r), range(8) b(j)),
    x AS (SELECT row, j, sqrt(-2 * ln(greatest(u, {generate.EPSILON!r}::DOUBLE))) AS s, 2 * pi() * v AS t FROM c)
    SELECT row, 2 * j AS dim, round(CAST(CAST(s * cos(t) AS FLOAT) AS DOUBLE), 4) + 0.0::DOUBLE AS value FROM x UNION ALL SELECT row, 2 * j + 1 AS dim, round(CAST(CAST(s * sin(t) AS FLOAT) AS DOUBLE), 4) + 0.0::DOUBLE AS value FROM x""")
def generate_gaussian(spark, sf_dir):
    each = generate.gaussian(spark, base(spark, sf_dir).count(), 16).select("row", F.posexplode("vector").alias("dim", "value"))
    return rounded(each.select("row", F.col("dim").cast("bigint").alias("dim"), F.col("value").cast("double").alias("value")), "value", digits=4)


@query("generate_clustered_bits", f"""WITH bit AS (SELECT r::BIGINT AS row, i::BIGINT AS bit, ({mixed_sql('r', '0', 42, 8)} % 256)::BIGINT AS centre, ({mixed_sql('r', 'i', 42, 9)} & 255) < 25 AS flip FROM (SELECT unnest(range((SELECT count(*) FROM embeddings))) AS r), range(168) b(i)),
    centres AS (SELECT c::BIGINT AS centre, i::BIGINT AS bit, ({mixed_sql('c', 'i // 64', 42, 7)} >> (i % 64)::INTEGER & 1) = 1 AS one FROM range(256) a(c), range(168) b(i))
    SELECT row, bit, (one <> flip) AS value FROM bit JOIN centres USING (centre, bit)""")
def generate_clustered_bits(spark, sf_dir):
    bits = generate.clustered_bits(spark, base(spark, sf_dir).count(), 168).select("row", F.posexplode(quantize.unpacked_bits(F.col("words"), 168)).alias("bit", "value"))
    return bits.select("row", F.col("bit").cast("bigint").alias("bit"), (F.col("value") == 1).alias("value"))


# ---------------------------------------------------------------- vector files


def _written(spark, sf_dir, ext: str) -> str:
    """The embeddings as shard files of a vector format; their pattern."""
    bigann.register(spark)
    rows = base(spark, sf_dir).select(F.col("key").alias("row"), "vector")
    if ext == "i8bin":
        rows = rows.withColumn("vector", quantize.to_integer(F.col("vector"), "i8", 127.0))
    elif ext == "u8bin":
        rows = rows.withColumn("vector", quantize.to_integer(F.col("vector"), "u8", 255.0))
    elif ext == "b1bin":
        rows = rows.select("row", quantize.sign_words(F.col("vector"), DIMS).alias("words"), F.lit(DIMS).alias("bits"))
    path = staging.shared_dir(spark)
    rows.repartitionByRange(3, "row").sortWithinPartitions("row").write.format("bigann").option("shards", "true").mode("append").save(f"{path}/base.{ext}")
    return f"{path}/base_*.{ext}"


def _numbers(df: DataFrame) -> DataFrame:
    each = df.select("row", F.posexplode("vector").alias("dim", "value"))
    return each.select("row", F.col("dim").cast("bigint").alias("dim"), F.col("value").cast("double").alias("value"))


@query("bigann_fbin", f"SELECT vec_id AS row, unnest(range(0, {DIMS})) AS dim, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings")
def bigann_fbin(spark, sf_dir):
    return _numbers(spark.read.format("bigann").load(_written(spark, sf_dir, "fbin")))


for _name in ("i8", "u8"):
    query(f"bigann_{_name}bin", f"SELECT vec_id AS row, unnest(range(0, {DIMS})) AS dim, CAST(unnest({INTEGER_SQL[_name]}) AS DOUBLE) AS value FROM embeddings")(lambda spark, sf_dir, ext=f"{_name}bin": _numbers(spark.read.format("bigann").load(_written(spark, sf_dir, ext))))


@query("bigann_b1bin", f"SELECT vec_id AS row, {SIGN_SQL} AS word, {DIMS} AS bits FROM embeddings")
def bigann_b1bin(spark, sf_dir):
    return spark.read.format("bigann").load(_written(spark, sf_dir, "b1bin")).select("row", F.col("words")[0].alias("word"), "bits")


@query("bigann_prefix_slice", "SELECT vec_id AS row, unnest(range(0, 16)) AS dim, CAST(unnest(embedding[1:16]) AS DOUBLE) AS value FROM embeddings WHERE vec_id >= 100 AND vec_id < 150")
def bigann_prefix_slice(spark, sf_dir):
    files = spark.read.format("bigann").option("dims", 16).load(_written(spark, sf_dir, "fbin"))
    return _numbers(sampling.sliced(files, 100, 150))


@query("bigann_ground_truth", f"{knn_sql(DISTANCE_SQL['l2'])} SELECT (query_id // 10) AS query_id, rank, key FROM r")
def bigann_ground_truth(spark, sf_dir):
    """Base, queries and ground truth written as a dataset; its neighbours read back."""
    path = staging.shared_dir(spark)
    rows = base(spark, sf_dir).select(F.col("key").alias("row"), "vector")
    generate.dataset(spark, rows, asked(spark, sf_dir).select((F.col("query_id") / 10).cast("bigint").alias("row"), "vector"), K, "l2", path, "fbin")
    return evaluate.truth_table(spark.read.format("bigann").load(f"{path}/groundtruth.ibin"))


@query("bigann_keys", "SELECT vec_id AS row, vec_id * 7 + 1 AS key FROM embeddings")
def bigann_keys(spark, sf_dir):
    bigann.register(spark)
    path = staging.shared_dir(spark)
    keys = base(spark, sf_dir).select(F.col("key").alias("row"), (F.col("key") * 7 + 1).alias("key"))
    keys.repartitionByRange("row").sortWithinPartitions("row").write.format("bigann").mode("append").save(f"{path}/keys.i32bin")
    return spark.read.format("bigann").load(f"{path}/keys.i32bin")


@query("gathered_rows", "SELECT e.event_id AS place, v.vec_id AS row, v.label FROM events e JOIN embeddings v ON v.vec_id = e.event_id * 7919 % (SELECT count(*) FROM embeddings)")
def gathered_rows(spark, sf_dir):
    """For each event a row of the whole base, by its number."""
    rows = base(spark, sf_dir).select(F.col("key").alias("row"), "label")
    places = table(spark, sf_dir, "events").select(F.col("event_id").alias("place"), (F.col("event_id") * 7919 % rows.count()).alias("row"))
    return sampling.gather(rows, places).select("place", "row", "label")


@query("corpus_lines", r"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, doc_id, replace(replace(replace(coalesce(text, ''), '\', '\\'), chr(10), '\n'), chr(13), '\r') AS line FROM documents)
    SELECT d.row, line, (doc_id * 37 % 256)::BIGINT AS first_byte FROM d""")
def corpus_lines(spark, sf_dir):
    """Texts and byte vectors written side by side, one line and one vector a row, read back and joined by row."""
    path = staging.shared_dir(spark)
    rows = sampling.global_rank(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", name="row")
    rows = rows.withColumn("vector", F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: ((F.col("doc_id") + i) * 37 % 256).cast("int")))
    generate.corpus(rows, path, "vector", "text")
    files = spark.read.format("bigann").load(f"{path}/base_*.b1bin")
    lines = spark.read.text(f"{path}/text").select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = sampling.global_rank(lines, "file", "block", "at", name="row")
    return lines.join(files, "row").select("row", F.col("value").alias("line"), F.col("words")[0].bitwiseAND(F.lit(255)).alias("first_byte"))


BYTES_SQL = "list_transform(range(128), lambda i: ((doc_id + i) * 37 % 256)::BIGINT)"


@query("corpus_ground_truth", f"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row, {BYTES_SQL} AS bytes FROM documents),
    q AS (SELECT row_number() OVER (ORDER BY {sampling.row_hash_sql('row')}, row) - 1 AS query_id, bytes FROM d ORDER BY query_id LIMIT 50),
    x AS (SELECT query_id, row AS key, list_sum(list_transform(list_zip(q.bytes, d.bytes), lambda z: bit_count(xor(z[1], z[2])))) AS distance FROM q, d),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) AS rank FROM x) SELECT query_id, rank, key FROM r WHERE rank <= {K}""")
def corpus_ground_truth(spark, sf_dir):
    """A corpus with sampled queries and their ground truth, read back from its file."""
    path = staging.shared_dir(spark)
    rows = sampling.global_rank(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", name="row")
    rows = rows.withColumn("vector", F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: ((F.col("doc_id") + i) * 37 % 256).cast("int")))
    generate.corpus(rows, path, "vector", "text", queries=50, k=K)
    return evaluate.truth_table(spark.read.format("bigann").load(f"{path}/groundtruth.ibin"))


@query("factory_strings", "SELECT l.label, l.rows, t.data_type, t.factory FROM (VALUES ('f32', 'IDMap,HNSW32,Flat'), ('f16', 'IDMap,HNSW32,SQfp16'), ('bf16', 'IDMap,HNSW32,SQbf16'), ('u8', 'IDMap,HNSW32,SQ8_direct'), ('i8', 'IDMap,HNSW32,SQ8_direct_signed'), ('b1', 'BHNSW32')) t(data_type, factory), (SELECT label, count(*) AS rows FROM embeddings GROUP BY label) l")
def factory_strings(spark, sf_dir):
    """An index for each label's rows, in each storage type."""
    kinds = spark.createDataFrame([(t, bench.factory_string(t, 32)) for t in ("f32", "f16", "bf16", "u8", "i8", "b1")], "data_type string, factory string")
    rows = base(spark, sf_dir).groupBy("label").agg(F.count("*").alias("rows"))
    return rows.crossJoin(F.broadcast(kinds)).select("label", "rows", "data_type", "factory")  # six rows a label


__all__ = ["ORACLES", "QUERIES", "top_k"]
