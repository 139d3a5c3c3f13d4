import math
import struct
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from neargrid.functions import metrics, quantize, text
from neargrid.operators import ann, evaluate, knn, sampling
from neargrid.plans import bench, generate, report
from neargrid.sources import bigann
from neargrid.streaming import topk


def vectors(spark, x, name="key"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} bigint, vector array<float>")


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(1)
    return r.standard_normal((60, 8)).astype(np.float32), r.standard_normal((5, 8)).astype(np.float32)


@pytest.mark.parametrize("name", [n for n, m in metrics.METRICS.items() if not m.bits])
def test_column_and_block_agree(spark, points, name):
    b, q = (np.abs(x) if name == "divergence" else x for x in points)
    base, asked = vectors(spark, b), vectors(spark, q, "query_id")
    one = {(r.query_id, r.rank): (r.key, round(r.distance, 9)) for r in knn.knn(base, asked, 7, name).collect()}
    two = {(r.query_id, r.rank): (r.key, round(r.distance, 9)) for r in knn.knn_join(base, asked, 7, name).collect()}
    assert one == two and len(one) == 35


@pytest.mark.parametrize("name", ["hamming", "jaccard", "sorensen"])
def test_bit_metrics_against_plain_bits(spark, points, name):
    b, q = (x > 0 for x in points)
    words = lambda x, n: vectors(spark, np.where(x, 1, -1), n).withColumn("vector", quantize.sign_words(F.col("vector"), 8))

    def plain(x, y):
        both, either, sizes = (x & y).sum(), (x | y).sum(), x.sum() + y.sum()
        return {"hamming": (x ^ y).sum(), "jaccard": 1 - both / either if either else 0, "sorensen": 1 - 2 * both / sizes if sizes else 0}[name]

    for f in (knn.knn, knn.knn_join):
        for r in f(words(b, "key"), words(q, "query_id"), 60, name).collect():
            assert r.distance == pytest.approx(plain(b[r.key], q[r.query_id]))


def test_ties_shards_and_blocks(spark):
    base = vectors(spark, [[1, 0], [0, 1], [-1, 0], [0, -1]])
    asked = vectors(spark, [[0, 0]], "query_id")
    assert [r.key for r in knn.knn(base, asked, 2).orderBy("rank").collect()] == [0, 1]
    sharded = base.withColumn("shard", F.col("key") % 2)
    assert [r.key for r in knn.merge_shards(knn.knn(sharded, asked, 2, by="shard"), 3).orderBy("rank").collect()] == [0, 2, 1]
    many = vectors(spark, np.eye(40), "query_id")
    small = knn.knn(vectors(spark, np.eye(40)), many, 3, query_bytes=1000)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, knn.knn(vectors(spark, np.eye(40)), many, 3).collect()))
    with pytest.raises(ValueError):
        knn.check_k(0)
    with pytest.raises(ValueError):
        knn.check_k(5, 4)
    with pytest.raises(ValueError):
        metrics.metric("nope")


@pytest.mark.parametrize("name, radius", [("l2", 2.0), ("cos", 1.0), ("manhattan", 3.0)])
def test_rows_within_a_radius(spark, name, radius):
    x = np.random.default_rng(9).integers(-1, 2, (80, 4)).astype(np.float32)  # many lie at the radius
    base, asked = vectors(spark, x), vectors(spark, x[:9], "query_id")
    want = (metrics.metric(name).block(x[:9].astype(float), x.astype(float)) <= radius).sum(axis=1)
    for size in (knn.QUERY_BYTES, 64):
        got = knn.radius_count(base, asked, radius, name, query_bytes=size).orderBy("query_id").collect()
        assert [r.within for r in got] == want.tolist()
    assert [r.within for r in knn.radius_count(base.where("false"), asked, radius, name).collect()] == [0] * 9
    assert knn.radius_count(base, asked.where("false"), radius, name).collect() == []


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, rank bigint, key bigint")


def test_evaluation_by_hand(spark):
    truth = ranked(spark, [(0, 1, 1), (0, 2, 2), (0, 3, 3)])
    assert evaluate.recall(ranked(spark, [(0, 1, 2), (0, 2, 3), (0, 3, 4)]), truth, 3).first()[0] == 0.0
    assert evaluate.recall(ranked(spark, [(0, 1, 5)]), ranked(spark, [(0, 1, 7)]), 2).first()[0] == 0.0
    two = ranked(spark, [(0, 1, 1), (0, 2, 2)])
    assert evaluate.ndcg(two, two, 2).first()[0] == pytest.approx(1.0)
    shifted = evaluate.ndcg(ranked(spark, [(0, 1, 9), (0, 2, 1)]), two, 2).first()[0]
    assert shifted == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    rows = [(0.3, 3, 10), (0.5, 3, 10), (0.4, 0, 10)]
    got = [round(r[0], 9) for r in spark.createDataFrame(rows, "raw double, i int, n int").select(evaluate.normalized(F.col("raw"), F.col("i"), F.col("n"))).collect()]
    assert got == [1.0, 1.0, 0.0]


def test_epochs():
    assert [n for _, _, n in sampling.epoch_sizes(10, 3)] == [4, 4, 2]
    assert [n for _, _, n in sampling.epoch_sizes(10, 7)] == [2, 2, 2, 2, 2, 0, 0]


def test_epoch_curve_equals_direct_searches(spark, points):
    b, q = points
    base = vectors(spark, b).withColumn("row", F.col("key"))
    asked = vectors(spark, q, "query_id")
    got = sorted((r.step, r.query_id, r["rank"], r.key) for r in bench.epoch_curve(base, asked, 4, 7, 60).collect())
    want = []
    for e, first, n in sampling.epoch_sizes(60, 7):
        want += [(e, r.query_id, r["rank"], r.key) for r in knn.knn(base.where(F.col("row") < first + n), asked, 4).collect()]
    assert got == sorted(want)


def test_quantization():
    x = np.array([200.7, -1.9, -300.0])
    assert np.trunc(np.clip(x, -128, 127)).tolist() == [127, -1, -128]
    assert quantize.rounded(np.array([0.3, -700, 1e9]), "e4m3").tolist() == [0.3125, -448.0, 448.0]
    assert quantize.rounded(np.array([1.0, 1.00390625, 3.0]), "bf16").tolist() == [1.0, 1.0, 3.0]
    assert quantize.grid("e2m3").max() == 7.5 and quantize.grid("e3m2").max() == 28
    for bad in (0, 5):
        with pytest.raises(ValueError):
            quantize.check_dims(bad, 4)
    with pytest.raises(ValueError):
        quantize.check_dims(12, 16, bits=True)


def test_integers_clamp_then_truncate(spark):
    df = spark.createDataFrame([([200.7, -1.9, -300.0, 255.9],)], "v array<double>")
    r = df.select(quantize.to_integer(F.col("v"), "i8").alias("i"), quantize.to_integer(F.col("v"), "u8").alias("u")).first()
    assert list(r.i) == [127, -1, -128, 127] and list(r.u) == [200, 0, 0, 255]


def test_text(spark):
    r = spark.createDataFrame([("a\\b\nc\r",)], "t string").select(text.escaped_line(F.col("t"))).first()[0]
    assert r == "a\\\\b\\nc\\r"
    names = ["shard_10", "shard_2", "shard_1", "a1b10", "a1b9"]
    assert sorted(names, key=text.natural_key) == ["a1b9", "a1b10", "shard_1", "shard_2", "shard_10"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [x.n for x in df.orderBy(text.natural_order(F.col("n"))).collect()] == ["a1b9", "a1b10", "shard_1", "shard_2", "shard_10"]


@pytest.mark.parametrize("ext, rows", [("fbin", [[1.5, -2.0, 3.0]] * 7), ("u8bin", [[0, 255, 7]] * 5), ("i8bin", [[-128, 127, 1]] * 5)])
def test_vector_files_round_trip(spark, tmp_path, ext, rows):
    bigann.register(spark)
    kind = {"fbin": "float", "u8bin": "smallint", "i8bin": "tinyint"}[ext]
    for s in (1, 2, 10):
        df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"row bigint, vector array<{kind}>").coalesce(1)
        df.write.format("bigann").mode("append").save(str(tmp_path / f"shard_{s}.{ext}"))
    back = spark.read.format("bigann").option("rowsPerTask", 2).load(str(tmp_path / f"shard_*.{ext}")).orderBy("row").collect()
    assert [list(r.vector) for r in back] == rows * 3 and [r.row for r in back] == list(range(3 * len(rows)))
    part = spark.read.format("bigann").option("from", 3).option("to", 6).option("dims", 2).load(str(tmp_path / f"shard_*.{ext}")).collect()
    assert sorted(r.row for r in part) == [3, 4, 5] and all(len(r.vector) == 2 for r in part)


def test_bits_neighbours_keys_and_errors(spark, tmp_path):
    bigann.register(spark)
    bits = generate.clustered_bits(spark, 50, 24, clusters=3)
    bits.coalesce(1).sortWithinPartitions("row").write.format("bigann").mode("append").save(str(tmp_path / "x.b1bin"))
    assert sorted(map(str, spark.read.format("bigann").load(str(tmp_path / "x.b1bin")).collect())) == sorted(map(str, bits.collect()))
    spark.createDataFrame([(0, [3, 1]), (1, [2, 4294967295])], "query_id bigint, neighbors array<bigint>").coalesce(1).write.format("bigann").mode("append").save(str(tmp_path / "g.ibin"))
    assert [list(r.neighbors) for r in spark.read.format("bigann").load(str(tmp_path / "g.ibin")).orderBy("query_id").collect()] == [[3, 1], [2, 4294967295]]
    (tmp_path / "k.i32bin").write_bytes(struct.pack("<IIIII", 3, 1, 7, 8, 9))
    assert [r.key for r in spark.read.format("bigann").load(str(tmp_path / "k.i32bin")).orderBy("row").collect()] == [7, 8, 9]
    (tmp_path / "short.fbin").write_bytes(b"1234567")
    (tmp_path / "body.fbin").write_bytes(struct.pack("<II", 2, 4) + b"0" * 31)
    (tmp_path / "s_1.fbin").write_bytes(struct.pack("<II", 0, 4))
    (tmp_path / "s_2.fbin").write_bytes(struct.pack("<II", 0, 5))
    for path, why in (("short.fbin", "header"), ("x.xyz", "extension"), ("body.fbin", "too small"), ("s_*.fbin", "differs"), ("none_*.fbin", "no file")):
        with pytest.raises(bigann.FormatError, match=why):
            bigann.shards(str(tmp_path / path))


def test_generators_do_not_depend_on_partitions(spark):
    one = sorted((r.row, tuple(r.vector)) for r in generate.gaussian(spark, 300, 5).collect())
    two = sorted((r.row, tuple(r.vector)) for r in generate.gaussian(spark, 100, 5).union(generate.gaussian(spark, 200, 5, first=100)).collect())
    assert one == two
    x = np.array([v for _, v in one])
    assert abs(x.mean()) < 0.1 and abs(x.std() - 1) < 0.1
    centres = generate.clustered_bits(spark, 400, 168, clusters=1, noise=0.0).collect()
    noisy = generate.clustered_bits(spark, 400, 168, clusters=1, noise=0.1).collect()
    flips = sum(bin((a ^ b) & (2**64 - 1)).count("1") for r, s in zip(centres, noisy, strict=True) for a, b in zip(r.words, s.words, strict=True))
    assert abs(flips / (400 * 168) - 25 / 256) < 0.01


def test_dataset_with_ground_truth(spark, tmp_path):
    base, asked = generate.gaussian(spark, 200, 6), generate.gaussian(spark, 10, 6, first=1000).withColumn("row", F.col("row") - 1000)
    generate.dataset(spark, base, asked, 3, "l2", str(tmp_path), "fbin")
    truth = spark.read.format("bigann").load(str(tmp_path / "groundtruth.ibin"))
    x = np.array([r.vector for r in base.orderBy("row").collect()])
    for r in truth.collect():
        q = np.array(asked.where(F.col("row") == r.query_id).first().vector)
        assert list(r.neighbors) == np.argsort(((x - q) ** 2).sum(axis=1), kind="stable")[:3].tolist()


def test_backends_runs_and_reports(spark, tmp_path):
    base, asked = generate.gaussian(spark, 400, 8), generate.gaussian(spark, 20, 8, first=5000)
    asked = asked.withColumnRenamed("row", "query_id")
    truth = knn.knn(base.withColumnRenamed("row", "key"), asked, 10).drop("distance")
    spec = bench.BenchSpec(base, asked, truth, 10, epochs=2, output=str(tmp_path / "out"))
    outcomes = bench.sweep(spec, lambda c: ann.FlatIndex() if c["m"] == 0 else 1 / 0, list(bench.grid(m=[0, 1])), "flat")
    assert outcomes == {"ran": 1, "skipped": 0, "failed": 1}
    reports = report.load(spark, str(tmp_path / "out"))
    steps = reports.select(F.explode("steps").alias("s")).select("s.*").orderBy("vectors_indexed").collect()
    assert [s.vectors_indexed for s in steps] == [200, 400] and steps[-1].recall_at_1 == 1.0 and steps[-1].ndcg_at_10 == pytest.approx(1.0)
    assert report.series(reports).count() == 2 * len(report.CHARTS)
    for index in (ann.GraphIndex("l2", block_rows=150), ann.SignLsh(8, "l2")):
        index.add(base.withColumnRenamed("row", "key"))
        index.save(str(tmp_path / type(index).__name__))
        again = ann.load(spark, str(tmp_path / type(index).__name__))
        found = again.search(asked, 10)
        assert evaluate.recall(found, truth, 10).first()[0] >= 0.9


def test_stream_follows_the_base(spark, tmp_path, points):
    b, q = points
    base, asked = vectors(spark, b), vectors(spark, q, "query_id")
    base.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(base.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    topk.follow(stream, asked, 4, str(tmp_path / "state"), str(tmp_path / "check"), once=True).awaitTermination()
    got = topk.version(spark, str(tmp_path / "state"), 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, knn.knn(base, asked, 4).collect()))


def test_order_sample_and_places(spark):
    base = spark.range(500).withColumnRenamed("id", "row")
    got = sorted(r.perm for r in sampling.insertion_order(base).collect())
    assert got == list(range(500))
    a, b = ([r.row for r in sampling.sample(x, 20).collect()] for x in (base, base.repartition(7)))
    assert a == b and len(set(a)) == 20
    offsets = sampling.shard_offsets(spark.createDataFrame([(0, 3), (1, 0), (2, 4)], "shard bigint, rows bigint"))
    assert [(r.row, r.shard, r.local) for r in sampling.locate(base.where("row < 8"), offsets).orderBy("row").collect()] == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 2, 0), (4, 2, 1), (5, 2, 2), (6, 2, 3)]


def test_staged_tables_are_deleted(spark):
    import os

    from neargrid.sources import staging

    df = staging.stage(spark.range(10))
    path = staging._NAMED[-1].removeprefix("file://")
    assert df.count() == 10 and os.path.isdir(path)
    staging.clear(spark)
    assert not os.path.exists(path) and not staging._NAMED


def test_metrics_count_all_queries(spark):
    truth = ranked(spark, [(0, 1, 1), (1, 1, 2)])
    results = ranked(spark, [(0, 1, 1)])
    assert evaluate.recall(results, truth, 10).first()[0] == 0.5 == evaluate.ndcg(results, truth, 10).first()[0]
    four = spark.range(4).withColumnRenamed("id", "query_id")
    assert evaluate.recall(results, truth, 10, queries=four).first()[0] == 0.25
    steps = results.withColumn("step", F.lit(3)).unionByName(results.withColumn("step", F.lit(4)).withColumn("key", F.lit(9)))
    assert {(r.step, r.recall) for r in evaluate.recall(steps, truth, 10, "step").collect()} == {(3, 0.5), (4, 0.0)}
    assert evaluate.recall(results.limit(0), truth.limit(0), 10).first()[0] == 0.0


def test_order_is_mixed_for_rows_of_any_size(spark):
    big = spark.createDataFrame([(4_000_000_000,), (10**15,), (0,), (1,), (2,)], "row bigint")
    assert len({r.h for r in big.select(sampling.row_hash(F.col("row")).alias("h")).collect()}) == 5
    order = [r.row for r in sampling.insertion_order(spark.range(3000).withColumnRenamed("id", "row")).orderBy("perm").collect()]
    steps = np.diff(order)
    assert len(set(steps.tolist())) > 1500  # a lattice has three


def test_shard_files_are_pruned_by_row(spark, tmp_path):
    bigann.register(spark)
    rows = spark.range(1000).select(F.col("id").alias("row"), F.array(F.col("id").cast("float")).alias("vector"))
    rows.repartitionByRange(4, "row").sortWithinPartitions("row").write.format("bigann").option("shards", "true").mode("append").save(str(tmp_path / "b.fbin"))
    assert len(list(tmp_path.iterdir())) == 4
    files = spark.read.format("bigann").load(str(tmp_path / "b_*.fbin"))
    some = files.where("row >= 240 AND row < 260")
    assert sorted((r.row, r.vector[0]) for r in some.collect()) == [(i, float(i)) for i in range(240, 260)]
    reader = bigann.BigAnnReader(str(tmp_path / "b_*.fbin"), {})
    list(reader.pushFilters([bigann.GreaterThanOrEqual(("row",), 240), bigann.LessThan(("row",), 260)]))
    assert sum(p.count for p in reader.partitions()) == 20
    assert [r.row for r in files.where("row = 7").collect()] == [7] and files.where("row IN (3, 900)").count() == 2
    wide = np.arange(3 * 3000, dtype="<f4").reshape(3, 3000)
    (tmp_path / "w.fbin").write_bytes(struct.pack("<II", *wide.shape) + wide.tobytes())
    assert [list(r.vector) for r in spark.read.format("bigann").option("dims", 2).load(str(tmp_path / "w.fbin")).orderBy("row").collect()] == wide[:, :2].tolist()


def test_guards_and_names(tmp_path):
    bench.check_single(None, [{}, {}])
    with pytest.raises(ValueError):
        bench.check_single("x", [{}, {}])
    with pytest.raises(ValueError):
        knn.check_k(3, 10, 4, 5)
    with pytest.raises(ValueError):
        bench.factory_string("f64", 8)
    assert bench.factory_string("b1", 8) == "BHNSW8" and bench.resident_bytes() > 1 << 20


def test_byte_vectors_have_one_width(spark):
    good = spark.createDataFrame([(0, list(range(16))), (1, [255] * 16)], "row bigint, v array<int>")
    assert [list(r.words) for r in generate.binary_embeddings(good, "v", 16).orderBy("row").collect()][1] == [-1, -1]
    for bad in ([1] * 15, [256] * 16):
        with pytest.raises(Exception, match="bytes"):
            generate.binary_embeddings(spark.createDataFrame([(0, bad)], "row bigint, v array<int>"), "v", 16).collect()


@pytest.mark.parametrize("name", ["l2", "ip", "cos"])
def test_tiles_give_the_k_nearest(name, monkeypatch):
    r = np.random.default_rng(6)
    b, q = np.round(r.standard_normal((700, 5)), 1), np.round(r.standard_normal((23, 5)), 1)
    monkeypatch.setattr(knn, "BASE_TILE", 64)
    monkeypatch.setattr(knn, "QUERY_TILE", 7)
    scan = knn.Scan(q, 9, name)
    for a in range(0, 700, 150):
        scan.add(np.arange(a, min(a + 150, 700)), b[a : a + 150])
    d = metrics.metric(name).block(q, b)
    want = np.array([sorted(range(700), key=lambda i: (x[i], i))[:9] for x in d])
    assert np.array_equal(scan.key, want) and np.array_equal(scan.dist, np.take_along_axis(d, want, axis=1))


@pytest.mark.parametrize("name", ["manhattan", "divergence"])
@pytest.mark.parametrize("scale", [1.0, 1e-5, 1e35])
def test_bounds_leave_few_pairs_to_score(name, scale, monkeypatch):
    r = np.random.default_rng(8)
    b, q = np.abs(r.standard_normal((3000, 16))) * scale, np.abs(r.standard_normal((40, 16))) * scale
    b[::50], b[1::50, :9], q[3] = b[7], 0, 0  # copies, parts and rows of zeros
    d = metrics.metric(name).block(q, b)
    monkeypatch.setattr(knn, "BASE_TILE", 1000)
    monkeypatch.setattr(knn, "QUERY_TILE", 15)
    monkeypatch.setattr(knn, "PAIRS", 100)
    scan, scored = knn.Scan(q, 9, name), []
    kept = scan.metric
    scan.metric = replace(kept, block=None, pairs=lambda x, y: scored.append(len(x)) or kept.pairs(x, y))
    for a in range(0, 3000, 1000):
        scan.add(np.arange(a, a + 1000), b[a : a + 1000])
    want = np.array([sorted(range(3000), key=lambda i: (x[i], i))[:9] for x in d])
    assert np.array_equal(scan.key, want) and np.array_equal(scan.dist, np.take_along_axis(d, want, axis=1))
    assert sum(scored) < 0.2 * d.size or scale > 1


def test_a_large_join_is_made_by_tiles(spark, points, monkeypatch):
    base, asked = vectors(spark, points[0]), vectors(spark, points[1], "query_id")
    want = sorted(map(tuple, knn.knn_join(base, asked, 5).collect()))
    monkeypatch.setattr(knn, "JOINED", 0)
    large = knn.knn_join(base, asked, 5)
    assert "NestedLoop" not in large._jdf.queryExecution().toString() and sorted(map(tuple, large.collect())) == want


@pytest.mark.parametrize("n", [1, 2, 3, 10, 37, 1000, 4097])
def test_permutation_without_a_sort(spark, n, capsys):
    df = spark.range(n).select("id", sampling.permuted(F.col("id"), n).alias("place"))
    df = df.withColumn("back", sampling.unpermuted(F.col("place"), n))
    rows = df.collect()
    assert sorted(r.place for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    df.explain()
    assert "Exchange" not in capsys.readouterr().out
    if n > 100:
        other = {r.id: r.p for r in df.select("id", sampling.permuted(F.col("id"), n, 7).alias("p")).collect()}
        assert sum(other[r.id] == r.place for r in rows) < 10
        steps = np.diff([r.place for r in sorted(rows)])
        assert len(set(steps.tolist())) > n / 2


def test_candidates_are_scored_in_blocks(spark, points):
    base, asked = vectors(spark, points[0]), vectors(spark, points[1], "query_id")
    every = asked.select("query_id").crossJoin(base.select("key"))
    for name in ("cos", "pearson"):
        near = knn.rerank(every, base, asked, 5, name)
        assert ("MapInArrow" in near._jdf.queryExecution().toString()) == (name == "cos")
        assert sorted(map(tuple, near.collect())) == sorted(map(tuple, knn.knn(base, asked, 5, name).collect()))
