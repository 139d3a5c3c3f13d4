import collections
import math
import re
import zlib

import numpy as np

from neargrid.llm import maxent, queries

from .cases import EDGE, SF, documents, edge, none


def brute(rows):
    """All columns but the score."""
    cut = [re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for _, t in rows]
    out_ = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    c = collections.Counter(w for x, o in zip(cut, out_, strict=True) if not o for w in x)
    n, v = sum(c.values()), len(c)
    return sorted(((d, o, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), 6)) for (d, _), x, o in zip(rows, cut, out_, strict=True)), key=repr)


def columns(df):
    got = df.collect()
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr), got


def test_query(spark):
    docs = documents()
    plain, got = columns(queries.op8_maxent_language_model(spark, SF))
    assert plain == brute([*zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)])
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_edge_and_empty(spark):
    plain, got = columns(maxent.score(edge(spark)))
    assert plain == brute(EDGE)
    assert all(r.score < 0 and np.isfinite(r.score) for r in got)
    assert maxent.score(none(spark)).collect() == []


def test_probabilities_sum_to_one(spark):
    docs = documents().head(60)
    df = spark.createDataFrame([*zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)], "doc_id long, text string").coalesce(1)
    chunks = maxent.chunked(df)
    counted = maxent.count_words(chunks, 3, 2)
    model, _, _ = maxent.fit(chunks, counted)
    import pyarrow as pa

    words = sorted({w for t in docs.text for w in t.lower().split()})
    table = lambda texts: maxent.Tokens(pa.table({"nth": pa.array(range(len(texts)), pa.int32()), "doc_id": pa.array([1] * len(texts), pa.int64()), "text": pa.array([x.encode() for x in texts])}))
    start = docs.text[3].lower().split()[:3]
    t = table([" ".join([*start, w]) for w in words] + [" ".join(start)])
    everything = table([x for x in docs.text])
    c = {int(h): int(n) for h, n in zip(everything.hashes, np.bincount(everything.of[np.repeat([not maxent.held_out(d) for d in docs.doc_id], everything.sizes)], minlength=len(everything.hashes) + 1), strict=False)}
    counts = np.array([c.get(int(h), 0) for h in t.hashes])
    logs = model.logs(t, counts)
    known = np.array([c.get(int(t.hashes[t.of[b + 3]]), 0) > 0 for b in t.bounds[:-2]])
    p = np.exp(logs[t.bounds[:-2] + 3])[known].sum() + np.exp(logs[t.bounds[-2] + 3])
    # the rest is the unknown word of each class
    assert 0.9 < p < 1.0 + 1e-6


def test_chunks_stay_whole_where_files_are_split(spark):
    docs = documents()
    rows = [*zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    hadoop, old = spark.sparkContext._jsc.hadoopConfiguration(), {}
    small = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1k"}
    for k, v in small.items():
        old[k] = spark.conf.get(k)
        spark.conf.set(k, v)
    hadoop.set("parquet.block.size", "16384")
    try:
        plain, _ = columns(maxent.score(df))
    finally:
        hadoop.unset("parquet.block.size")
        for k, v in old.items():
            spark.conf.set(k, v)
    assert plain == brute(rows)


def test_counts_beyond_32_bits():
    rows = np.zeros(2, dtype=maxent.SENT)
    rows["hash"], rows["n"] = [5, 9], [5_000_000_000, (1 << 60) + 1]
    first = next(iter(maxent._sum_counts([(1, rows.tobytes(), 0), (2, rows.tobytes(), 0)], 10)))
    assert np.frombuffer(first.column("data")[0].as_py(), "<u8").tolist() == [10_000_000_000, (1 << 61) + 2]


def test_scores_equal_the_formula(spark):
    docs = documents().head(40)
    df = spark.createDataFrame([*zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)], "doc_id long, text string").coalesce(1)
    chunks = maxent.chunked(df)
    model, n, _ = maxent.fit(chunks, maxent.count_words(chunks, 3, 2))
    table = next(iter(maxent._tables([r for r in pa_batches(chunks)])))[1]
    t = maxent.Tokens(table)
    counts = t.counts()
    logs = model.logs(t, counts)
    kind = model.classes(t)[0]
    slots = model.features(t, kind)
    c = [*counts.tolist(), 0]
    for d in range(0, 40, 5):
        for i in range(t.bounds[d], min(t.bounds[d] + 12, t.bounds[d + 1])):
            w, past = t.of[i], [t.of[i - k] for k in (1, 2, 3) if i - k >= t.bounds[d]]
            z = [model.bias[k] + sum(float(model.weights[s, k]) for s in slots[i]) for k in range(maxent.CLASSES)]
            want = z[kind[w]] - math.log(sum(math.exp(x) for x in z))
            if maxent.SINGLES <= kind[w] != maxent.END_CLASS:
                share = lambda x: (c[x] + maxent.ADD) / (model.words[kind[x]] + maxent.ADD * (model.kinds[kind[x]] + 1))
                seen, norm, bonus = set(), 1.0, 0.0
                for weight, x in zip(model.again, past, strict=False):
                    if x not in seen and kind[x] == kind[w]:
                        norm += share(x) * (math.exp(weight) - 1)
                        bonus += weight * (x == w)
                    seen.add(x)
                want += math.log(share(w)) + bonus - math.log(norm)
            assert abs(want - logs[i]) < 1e-3, (d, i)


def pa_batches(chunks):
    return chunks.toArrow().to_batches()
