import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from neargrid.llm import queries, toxicity
from neargrid.llm.common import crc_mod

from .cases import SF, documents, edge, none


def test_index_is_exact():
    r = np.random.default_rng(4)
    n, v = 500, 40
    x = r.random((n, v)) * (r.random((n, v)) < 0.1)
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
    x[7] = x[8] = x[9]
    digests = [f"{i * 37 % n:04d}".encode() for i in range(n)]
    index = toxicity.BlockMaxIndex.build(digests, np.zeros(n, dtype=int), np.ones(n), [(np.flatnonzero(y), y[y > 0]) for y in x], np.ones(v))
    for trial in range(50):
        q = x[9].copy() if not trial else r.random(v) * (r.random(v) < 0.15)
        terms = np.flatnonzero(q)
        if not len(terms):
            continue
        q /= np.sqrt((q * q).sum())
        places, scores = index.nearest(terms, q[terms], 7, digests[8])
        s = x @ q
        want = sorted((-round(s[i], 9), digests[i]) for i in range(n) if s[i] > 0 and i != 8)[:7]
        assert [(-round(c, 9), index.digests[p]) for p, c in zip(places, scores, strict=True)] == want


def test_isotonic_fit():
    r = np.random.default_rng(5)
    x = r.random(300)
    y = (r.random(300) < x**2).astype(float)
    at, value = toxicity.isotonic(x, y, np.ones(300))
    assert (np.diff(at) > 0).all() and (np.diff(value) > 0).all() and 0 <= value[0] and value[-1] <= 1
    assert abs(np.interp(x, at, value).mean() - y.mean()) < 0.03


def brute_force(docs, labels, k):
    """Scores from the definition, with dictionaries and all pairs."""
    words = {}
    for d, t in docs:
        w = [x.lower() for x in (t or "").split()]
        words[d] = Counter(w) + Counter(("4", x[:4]) for x in w if len(x) > 4)
    train = {d: y for d, y in labels if zlib.crc32(str(d).encode()) % 4 != 2}
    n = {v: sum(y == v for y in train.values()) for v in (0, 1)}
    share, total = n[1] / len(train), len(docs)
    weight = {v: (n[v] / len(train)) * len(train) / n[v] for v in (0, 1)}
    df, bad, good = Counter(), Counter(), Counter()
    for d, c in words.items():
        df.update(c.keys())
        if d in train:
            (bad if train[d] else good).update(c.keys())
    z = {}
    for t in bad.keys() | good.keys():
        p = (bad[t] + good[t] + 1) / (len(train) + 2)
        z[t] = abs(bad[t] / n[1] - good[t] / n[0]) / math.sqrt(p * (1 - p) * (1 / n[1] + 1 / n[0]))

    def unit(x):
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {t: v / norm if norm else v for t, v in x.items()}

    vectors = {d: unit({t: (1 + math.log(m)) * (math.log((1 + total) / (1 + (df[t] if t in z else 0))) + 1) for t, m in c.items()}) for d, c in words.items()}
    told = {d: unit({t: v * z.get(t, 0) for t, v in x.items()}) for d, x in vectors.items()}
    texts, out, cosines = dict(docs), {}, {}

    def dot(x, y):
        return sum(v * y.get(t, 0) for t, v in x.items())

    for d, x in vectors.items():
        near = [(c, e) for c, e in sorted(((dot(x, vectors[e]), e) for e in train if texts[e] != texts[d]), reverse=True)[:k] if c > 0]
        votes = [(dot(told[d], told[e]) ** 2 * weight[train[e]], train[e]) for _, e in near]
        out[d] = (sum(v for v, y in votes if y) + share) / (sum(v for v, _ in votes) + 1)
        cosines[d] = [c for c, _ in near]
    return out, cosines


def planted(spark, n=400):
    r = np.random.default_rng(9)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for d in range(n):
        text = list(r.choice(words, 60))
        bad = d % 5 == 0
        if bad:
            for w in r.choice(["vile", "nasty", "Foul", "grim"], 5):
                text.insert(int(r.integers(60)), w)
        rows.append((d, " ".join(text), "x"))
        if d % 8:
            labels.append((d, None, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_planted_words_are_learnt_and_held_out_rows_are_not_read(spark):
    docs, labels = planted(spark)
    got = {r.doc_id: r for r in toxicity.held_out_scores(docs, labels).collect()}
    assert len(got) == 400
    assert all(r.predicted == int(d % 5 == 0) and 0 <= r.score <= 1 for d, r in got.items())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    assert all(len(r.cosines) == len(r.labels) <= toxicity.NEAREST for r in got.values())
    left = toxicity.reject(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {d for d in range(400) if d % 5}


def test_query_and_edges(spark):
    got = queries.op5_nearest_toxicity(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(documents().doc_id.tolist())
    _, labels = planted(spark, 20)
    assert len(toxicity.held_out_scores(edge(spark), labels).collect()) == edge(spark).count()
    assert {r.score for r in toxicity.held_out_scores(edge(spark), labels.limit(0)).collect()} == {0.0}
    assert toxicity.held_out_scores(none(spark), labels).collect() == []


def test_query_equals_brute_force_up_to_calibration(spark):
    docs, labels = planted(spark, 200)
    want, cosines = brute_force([(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.toxic) for r in labels.collect()], toxicity.NEAREST)
    model = toxicity.fit(docs, labels, crc_mod("doc_id", 4) != 2)
    got = {r.doc_id: r for r in toxicity.held_out_scores(docs, labels).collect()}
    assert all(abs(r.score - float(model.calibrated(np.array([want[d]]))[0])) < 1e-6 for d, r in got.items())
    assert all(np.allclose(r.cosines, cosines[d]) for d, r in got.items())


def test_all_terms_of_a_text_are_in_its_norm(spark):
    docs, labels = planted(spark, 200)
    padded = docs.where("doc_id < 40").select((F.col("doc_id") + 1000).alias("doc_id"), F.concat_ws(" ", "text", F.expr("array_join(transform(sequence(1, 5000), i -> concat('u', doc_id, 'x', i)), ' ')")).alias("text"), "toxic")
    got = {r.doc_id: r for r in toxicity.held_out_scores(docs.unionByName(padded), labels).collect()}
    for d in range(40):
        assert max(got[d + 1000].cosines) < 0.2 * max(got[d].cosines)
        assert got[d + 1000].predicted == got[d].predicted == int(d % 5 == 0)  # padding does not hide what the text says


def test_labels_of_a_text_do_not_score_it(spark):
    docs, labels = planted(spark, 200)
    first = {r.doc_id: r.score for r in toxicity.held_out_scores(docs, labels).collect()}
    twice = toxicity.held_out_scores(docs.unionByName(docs.where("doc_id < 50").withColumn("doc_id", F.col("doc_id") + 1000)), labels).collect()
    again = {r.doc_id: r.score for r in twice}
    assert all(again[d] == again[d + 1000] for d in range(50)) and len(first) == 200


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op5_nearest_toxicity(spark, sf).collect()}
    known = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    right = sum(got[r.doc_id].predicted == r.toxic for r in known)
    assert right > 0.97 * len(known)
