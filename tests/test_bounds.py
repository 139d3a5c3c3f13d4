import numpy as np
import pytest
from pyspark.sql import functions as F

from neargrid.operators import ann, bounds
from neargrid.operators.knn import fetched, knn


def table(spark, x, name="key"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} bigint, vector array<float>")


def rows(df):
    return sorted((r.query_id, r["rank"], r.key, r.distance) for r in df.collect())


@pytest.mark.parametrize("name", bounds.METRICS)
def test_equals_the_scan_and_fetches_little(spark, name):
    r = np.random.default_rng(5)
    x = (r.standard_normal((3000, 12)) @ r.standard_normal((12, 24))).astype(np.float32)
    base, asked = table(spark, x).repartition(5), table(spark, x[::60] + 0.01, "query_id")
    index = bounds.BoundsIndex(name)
    index.add(base)
    assert rows(index.search(asked, 7)) == rows(knn(base, asked, 7, name))
    most, mean = index.fetches.agg(F.max("fetched"), F.avg("fetched")).first()
    assert mean < 12 and most < 60


@pytest.mark.parametrize("name", bounds.METRICS)
def test_ties_zero_vectors_constant_dimensions_and_short_bases(spark, name):
    x = [[0, 0, 5], [1, 0, 5], [1, 0, 5], [1, 0, 5], [-1, 0, 5], [0, 0, 0], [0, 0, 0], [1e-30, 0, 5]]
    base, asked = table(spark, x), table(spark, [[0, 0, 0], [1, 0, 5], [3, 3, 3]], "query_id")
    index = bounds.BoundsIndex(name)
    index.add(base)
    for k in (1, 3, 8, 20):
        assert rows(index.search(asked, k)) == rows(knn(base, asked, k, name))


def test_rows_beyond_the_first_range_and_blocks_of_queries(spark, monkeypatch):
    r = np.random.default_rng(6)
    x = r.standard_normal((400, 8)).astype(np.float32)
    later = (x[:200] * 40).astype(np.float32)
    base, more = table(spark, x), table(spark, later).withColumn("key", F.col("key") + 1000)
    asked = table(spark, np.concatenate([x[:20] * 30, x[:5]]), "query_id")
    index = bounds.BoundsIndex("l2")
    index.add(base)
    index.add(more)
    want = rows(knn(base.unionByName(more), asked, 6))
    assert rows(index.search(asked, 6)) == want
    # small blocks of queries, and tasks that pass on what they hold again and again
    monkeypatch.setattr(bounds, "POOL", 10)
    some = bounds.survivors(index.codes, asked, 6, "l2", *index._cells(), query_bytes=400)
    assert {(q, k) for q, _, k, _ in want} <= {tuple(r) for r in some.collect()}


def test_no_vector_is_decoded_beyond_its_residual(spark):
    x = np.random.default_rng(7).standard_normal((200, 6)).astype(np.float32) * [1, 10, 100, 1e-6, 1e6, 1]
    index = bounds.BoundsIndex()
    index.add(table(spark, x))
    low, step = index._cells()
    for r in index.codes.collect():
        code = np.frombuffer(r.code, dtype=np.uint8)[None, :]
        assert np.linalg.norm(x[r.key].astype(np.float32).astype(float) - bounds.decode(code, low, step)[0]) <= r.residual


def test_fetched_by_broadcast_and_by_shuffle(spark, monkeypatch):
    from neargrid.operators import knn as module

    base = table(spark, np.eye(6))
    some = spark.createDataFrame([(0, 1), (0, 5), (1, 5), (2, 77)], "query_id bigint, key bigint")
    one = sorted((r.query_id, r.key, tuple(r.vector)) for r in fetched(some, base).collect())
    monkeypatch.setattr(module, "QUERY_BYTES", 0)
    two = sorted((r.query_id, r.key, tuple(r.vector)) for r in fetched(some, base).collect())
    assert one == two and [r[:2] for r in one] == [(0, 1), (0, 5), (1, 5)]


@pytest.mark.parametrize("kind", ["bounds", "lsh"])
def test_save_and_load_read_what_was_built(spark, tmp_path, kind):
    x = np.random.default_rng(8).standard_normal((300, 8)).astype(np.float32)
    base, asked = table(spark, x), table(spark, x[:9], "query_id")
    index = bounds.BoundsIndex("cos") if kind == "bounds" else ann.SignLsh(8)
    index.add(base)
    index.save(str(tmp_path / kind))
    back = ann.load(spark, str(tmp_path / kind))
    assert rows(back.search(asked, 5)) == rows(index.search(asked, 5))
    assert back.size_bytes() == index.size_bytes()


def test_unknown_metric():
    with pytest.raises(ValueError):
        bounds.BoundsIndex("manhattan")


def test_no_more_is_held_than_the_pool_and_a_tile(monkeypatch):
    r = np.random.default_rng(4)
    x, asked = r.standard_normal((600, 4)), r.standard_normal((50, 4))
    monkeypatch.setattr(bounds, "POOL", 100)
    monkeypatch.setattr(bounds, "BASE_TILE", 40)
    monkeypatch.setattr(bounds, "QUERY_TILE", 10)
    sieve, most, passed = bounds.Sieve(asked, 3, "l2"), 0, []
    for some in sieve.add(np.arange(600), x, np.full(600, 2.0), np.linalg.norm(x, axis=1)):  # codes that tell little
        most = max(most, len(some[0]))
        passed.append(some)
    passed.append(sieve.drain())
    assert 0 < most <= 100 + 40 * 10 and len(passed) > 10
    pairs = {(q, k) for some in passed for q, k in zip(some[0].tolist(), some[1].tolist(), strict=True)}
    d = ((asked[:, None] - x[None]) ** 2).sum(axis=2)
    assert all((q, k) in pairs for q, row in enumerate(d) for k in np.argsort(row)[:3].tolist())
