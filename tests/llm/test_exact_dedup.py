import hashlib
import re

from neargrid.llm import exact_dedup, queries

from .cases import EDGE, SF, documents, edge, none


def brute(rows):
    groups = {}
    for i, (d, t) in enumerate(rows):
        t = t or ""
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t), []).append((-len(t), d is None, d or 0, i))
    out = []
    for content, members in groups.items():
        best = min(members)
        for m in members:
            name = lambda x: None if x[1] else x[2]
            out.append((name(m), name(best), len(members), m == best, hashlib.sha256(content.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


def test_edge_tables(spark):
    # a table of a few bytes is filled and spilled again and again
    for size, fan_out in ((1 << 26, 64), (50, 2), (2000, 3)):
        assert rows_of(exact_dedup.group_texts(edge(spark), size, fan_out)) == brute(EDGE)
    assert exact_dedup.group_texts(none(spark)).collect() == []
    kept = exact_dedup.deduplicate(edge(spark)).collect()
    assert sorted((r.doc_id or 0) for r in kept) == sorted((d or 0) for d, _, _, k, _ in brute(EDGE) if k)


def test_query(spark):
    docs = documents()
    assert rows_of(queries.op4_grace_exact_dedup(spark, SF)) == brute([*zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)])


def test_hot_group(spark):
    rows = [(i, "hot  text" if i % 3 == 0 else f"t{i % 50} {' ' * (i % 4)}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [r[:4] for r in rows_of(exact_dedup.group_texts(df, 100, 2)) ]
    assert sorted(got, key=repr) == sorted((r[:4] for r in brute(rows)), key=repr)
