"""Graphs by descent, their pruning, and the index over them, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from neargrid.operators import ann, descent, graph, knn


def table(spark, x, name="key", first=0):
    return spark.createDataFrame([(first + i, row.tolist()) for i, row in enumerate(x.astype(np.float32))], f"{name} long, vector array<float>")


def points(n, dims=24, inner=8, seed=1):
    r = np.random.default_rng(seed)
    shape = np.random.default_rng(99).standard_normal((inner, dims))
    return r.standard_normal((n, inner)) @ shape + 0.05 * r.standard_normal((n, dims))


def true_near(x, q, k, skip_self=False):
    x, q = x.astype(np.float32).astype(float), q.astype(np.float32).astype(float)
    d = ((q[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    if skip_self:
        np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def share(found, want):
    got = {(r[0], r[1]) for r in found.collect()}
    return sum((i, int(j)) in got for i, row in enumerate(want) for j in row) / want.size


def test_descent_joins_lists_that_first_edges_do_not(spark):
    x = points(1500)
    rows = descent.pack_vectors(table(spark, x), "key")
    # first edges: a ring of random rows
    r = np.random.default_rng(3)
    first = [(i, int(j), float(((x[i].astype(np.float32).astype(float) - x[j].astype(np.float32)) ** 2).sum()), True) for i in range(1500) for j in r.choice(1500, 12, replace=False) if i != j]
    edges = spark.createDataFrame(first, "node long, nbr long, dist double, new boolean")
    want = true_near(x, x, 10, True)
    assert share(edges.select("node", "nbr"), want) < 0.1
    better = descent.descend(rows, edges, 16, "l2", rounds=10)
    assert better.groupBy("node").count().agg(F.max("count")).first()[0] == 16
    assert better.where("node = nbr").count() == 0 and better.select("node", "nbr").distinct().count() == better.count()
    assert share(better.select("node", "nbr"), want) >= 0.9
    # nothing is new: no round
    again = descent.descend(rows, better.withColumn("new", F.lit(False)), 16, "l2")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, better.withColumn("new", F.lit(False)).collect()))


def brute_detours(lists):
    out = []
    for x, near in lists.items():
        for r, y in enumerate(near):
            ways = sum(1 for r1, z in enumerate(near[:r]) if y in lists.get(z, [])[:r])
            out.append((x, y, r, ways))
    return sorted(out)


@pytest.mark.parametrize("tile", [1 << 25, 64])
def test_detours(spark, monkeypatch, tile):
    monkeypatch.setattr(descent, "TILE_BYTES", tile)
    r = np.random.default_rng(5)
    lists = {i: r.choice(40, int(r.integers(1, 9)), replace=False).tolist() for i in range(40) if i % 9}
    df = spark.createDataFrame([(k, v) for k, v in lists.items()], "node long, nbrs array<long>").repartition(3)
    assert sorted(map(tuple, descent.detours(df).collect())) == brute_detours(lists)
    assert descent.detours(df.limit(0)).collect() == []


def test_pruned_graph_needs_fewer_distances(spark):
    x, q = points(2000), points(60, seed=2)
    near = true_near(x, x, 24, True)
    dist = lambda i, j: float(((x[i] - x[j]) ** 2).sum())
    edges = spark.createDataFrame([(i, int(j), dist(i, j)) for i in range(2000) for j in near[i]], "node long, nbr long, dist double").repartition(4)
    want, took = true_near(x, q, 10), {}
    for name, links in (("pruned", descent.prune(edges, 16)), ("both ways", descent.undirected(edges))):
        pairs = np.array(sorted(map(tuple, links.select("node", "nbr").collect())))
        ends = np.append(0, np.cumsum(np.bincount(pairs[:, 0], minlength=2000)))
        if name == "pruned":
            assert np.diff(ends).max() <= 16
        at, _, cost = graph.beam_search(x, ends, pairs[:, 1], q, "l2", 48, 10)
        found = np.mean([len(set(a.tolist()) & set(b.tolist())) / 10 for a, b in zip(at, want, strict=True)])
        took[name] = found, cost.mean()
    assert took["pruned"][0] >= 0.95 and took["pruned"][0] >= took["both ways"][0] - 0.02
    assert took["pruned"][1] < 0.7 * took["both ways"][1]


def found_share(index, q, want, spark):
    return share(index.search(table(spark, q, "query_id"), 10).select("query_id", "key"), want)


def test_recall_over_many_lists(spark, tmp_path):
    r = np.random.default_rng(8)
    x, q = r.standard_normal((4000, 24)), r.standard_normal((60, 24))  # without structure
    index = graph.GraphIndex("l2", block_rows=80)
    index.add(table(spark, x))
    assert len(index.centres) >= 40
    want = true_near(x, q, 10)
    assert found_share(index, q, want, spark) >= 0.9
    index.save(str(tmp_path / "g"))
    again = ann.load(spark, str(tmp_path / "g"))
    asked = table(spark, q, "query_id")
    assert sorted(map(tuple, again.search(asked, 10).collect())) == sorted(map(tuple, index.search(asked, 10).collect()))
    # a hop finds what few lists leave out
    index.probes, index.hops = 3, 0
    without = found_share(index, q, want, spark)
    index.hops = 2
    assert found_share(index, q, want, spark) > without


def test_beam_in_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "SCAN_ROWS", 10)
    x, q = points(1200), points(30, seed=2)
    index = graph.GraphIndex("l2", block_rows=300)
    index.add(table(spark, x))
    assert found_share(index, q, true_near(x, q, 10), spark) >= 0.9


def test_epochs_grow_the_graph(spark):
    x, q = points(1600), points(40, seed=2)
    cost = lambda i: i.trace(table(spark, q, "query_id"), 10).where("kind = 1").agg(F.sum("key")).first()[0]
    grown = graph.GraphIndex("l2", block_rows=40)
    for e in range(4):
        grown.add(table(spark, x[e * 400 : (e + 1) * 400], first=e * 400))
        assert found_share(grown, q, true_near(x[: (e + 1) * 400], q, 10), spark) >= 0.95
    once = graph.GraphIndex("l2", block_rows=40)
    once.add(table(spark, x))
    assert len(grown.centres) == len(once.centres) and grown.rows.count() == 1600
    assert cost(grown) < 2 * cost(once)
    assert share(grown.edges.select("node", "nbr"), true_near(x, x, 8, True)) >= 0.9


def test_equal_rows_and_empty_tables(spark):
    x = np.concatenate([np.zeros((400, 6)), points(300, 6, 4)])  # one vector holds more than half of all rows
    index = graph.GraphIndex("l2", block_rows=30)
    index.add(table(spark, x).limit(0))
    assert index.search(table(spark, x[:3], "query_id"), 5).count() == 0 and index.size_bytes() == 0
    index.add(table(spark, x))
    assert max(index.units.values()) > 1
    got = index.search(table(spark, np.concatenate([x[:2], x[500:504]]), "query_id"), 5).collect()
    assert len(got) == 30 and all(r.distance == 0 for r in got if r.query_id < 2) and {r.key for r in got if r.rank == 1 and r.query_id >= 2} == {500, 501, 502, 503}


@pytest.mark.parametrize("name", ["l2", "cos", "hamming"])
def test_grid(spark, name):
    r = np.random.default_rng(4)
    if name == "hamming":
        make = lambda n, c: spark.createDataFrame([(i, [int(v) for v in r.integers(-(2**62), 2**62, 2)]) for i in range(n)], f"{c} long, vector array<long>")
    else:
        make = lambda n, c: table(spark, np.round(r.standard_normal((n, 5)), 1), c)
    base, asked = make(230, "key"), make(70, "query_id")
    base, asked = base.cache(), asked.cache()
    want = sorted(map(tuple, knn.knn(base, asked, 7, name).collect()))
    for rows in (1000, 50, 19):
        assert sorted(map(tuple, knn.knn_grid(base, asked, 7, name, rows).collect())) == want
    assert knn.knn_grid(base.limit(0), asked, 7, name).collect() == []
    few = knn.knn_grid(base.where("key < 3"), asked, 7, name, 2)
    assert few.count() == 210


@pytest.mark.parametrize("rows", [10, 8192])
def test_filtered_search(spark, monkeypatch, rows):
    monkeypatch.setattr(graph, "SCAN_ROWS", rows)  # blocks are walked, or compared whole
    x, q = points(1500), points(30, seed=2)
    index = graph.GraphIndex("l2", block_rows=150)
    index.add(table(spark, x))
    asked, keys = table(spark, q, "query_id"), np.arange(1500)
    for allowed in (keys[keys % 100 == 7], keys[keys % 10 == 3], keys[keys % 2 == 0]):
        want = allowed[true_near(x[allowed], q, 10)]
        found = index.search(asked, 10, spark.createDataFrame([(int(i),) for i in allowed], "key long"))
        assert {r.key for r in found.collect()} <= set(allowed.tolist()) and share(found.select("query_id", "key"), want) >= 0.9
    assert index.search(asked, 10, spark.createDataFrame([], "key long")).count() == 0


def test_edges_are_shuffled_once(spark):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b), float(d), bool(n)) for a, b, d, n in zip(r.integers(0, 9, 400), r.integers(0, 30, 400), r.integers(0, 5, 400), r.integers(0, 2, 400), strict=True)]
    near = descent.nearest_edges(spark.createDataFrame(edges, "node long, nbr long, dist double, new boolean"), 4)
    assert near._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    best: dict = {}
    for a, b, d, n in edges:
        dist, new = best.get((a, b), (d, n))
        best[a, b] = min(d, dist), n and new
    want = {(a, b, *best[a, b]) for a in range(9) for b in sorted((b for x, b in best if x == a), key=lambda b: (best[a, b][0], b))[:4]}
    assert set(map(tuple, near.select("node", "nbr", "dist", "new").collect())) == want
