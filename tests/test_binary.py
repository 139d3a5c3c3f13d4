import numpy as np
import pytest
from pyspark.sql import functions as F

from neargrid.operators import binary, knn
from neargrid.plans import generate


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def clustered(spark, n, bits, first=0, **options):
    df = generate.clustered_bits(spark, n, bits, first=first, **options)
    return df.select(F.col("row").alias("key"), F.col("words").alias("vector")).cache()


def as_queries(df):
    return df.withColumnRenamed("key", "query_id")


def test_hamming_index_is_exact_and_looks_at_few(spark):
    base, asked = clustered(spark, 4000, 168, clusters=64), as_queries(clustered(spark, 40, 168, first=10_000, clusters=64))
    found, seen = binary.hamming_index(base, asked, 10, 168, 2)
    assert rows_of(found) == rows_of(knn.knn(base, asked, 10, "hamming"))
    assert seen.where("radius = -1").count() == 0
    assert seen.agg(F.sum("candidates")).first()[0] < 0.1 * 4000 * 40


def test_hamming_edges(spark):
    r = np.random.default_rng(7)
    rows = [(i, [int(r.integers(0, 4)), -1]) for i in range(60)] + [(100 + i, [int(r.integers(-(2**62), 2**62)), int(r.integers(-(2**62), 2**62))]) for i in range(30)]
    base = spark.createDataFrame(rows, "key long, vector array<long>").cache()
    asked = as_queries(base.where("key % 4 = 0"))
    want = rows_of(knn.knn(base, asked, 6, "hamming"))
    for most in (0, 1, 3):  # ties, many equal pieces, and queries that only a scan ends
        found, seen = binary.hamming_index(base, asked, 6, 128, most)
        assert rows_of(found) == want
    assert {r.radius for r in seen.collect()} >= {0, -1}
    few = base.where("key < 3")
    assert rows_of(binary.hamming_index(few, asked, 6, 128, 1)[0]) == rows_of(knn.knn(few, asked, 6, "hamming"))
    assert binary.hamming_index(base, asked.limit(0), 6, 128)[0].count() == 0
    assert binary.hamming_index(base.limit(0), asked, 6, 128, 1)[0].count() == 0


@pytest.mark.parametrize("name", ["jaccard", "sorensen"])
@pytest.mark.parametrize("block", [8192, 7])
def test_popcount_search(spark, name, block):
    r = np.random.default_rng(9)
    dense = r.choice([0.03, 0.1, 0.3, 0.5], 600)
    code = lambda p: [int(np.packbits(r.random(64) < p).view(">i8")[0]) for _ in range(2)]
    rows = [(i, code(p)) for i, p in enumerate(dense)] + [(1000 + i, [0, 0]) for i in range(25)] + [(2000, [-1, -1])]
    base = spark.createDataFrame(rows, "key long, vector array<long>").cache()
    asked = as_queries(base.where("key % 9 = 0"))
    found, seen = binary.popcount_search(base, asked, 5, name, block)
    assert rows_of(found) == rows_of(knn.knn(base, asked, 5, name))
    assert seen.count() == asked.count() and seen.agg(F.sum("compared")).first()[0] < 0.8 * base.count() * asked.count()
    assert rows_of(binary.popcount_search(base.where("key < 3"), asked, 5, name)[0]) == rows_of(knn.knn(base.where("key < 3"), asked, 5, name))
    assert binary.popcount_search(base.limit(0), asked, 5, name)[0].count() == 0 == binary.popcount_search(base, asked.limit(0), 5, name)[0].count()


def test_flips():
    assert [len(binary.flips(s)) for s in range(4)] == [1, 16, 120, 560] and all(bin(x).count("1") == 3 for x in binary.flips(3))


@pytest.mark.parametrize("listed", [0, 1 << 30])
def test_pairs_of_a_round_are_never_stored(spark, monkeypatch, listed):
    base, asked = clustered(spark, 1500, 32, clusters=4), as_queries(clustered(spark, 20, 32, first=10_000, clusters=4))
    stored, keep = [], binary.stage

    def stage(df, **options):
        out = keep(df, **options)
        if {"query_id", "key"} <= set(out.columns):
            stored.append(out.count())
        return out

    monkeypatch.setattr(binary, "stage", stage)
    monkeypatch.setattr(binary, "ROUND", 0 if listed else 1 << 24)
    monkeypatch.setattr(binary, "LISTED", listed)
    found, seen = binary.hamming_index(base, asked, 5, 32, 1)
    assert rows_of(found) == rows_of(knn.knn(base, asked, 5, "hamming"))
    assert max(stored, default=0) <= 5 * 20
    assert {r.radius for r in seen.collect()} == {-1} if listed else seen.where("radius = 0").agg(F.sum("candidates")).first()[0] > 5 * 20
