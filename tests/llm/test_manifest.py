import hashlib
import zlib

import duckdb
import pytest

from neargrid.llm import manifest, queries

from .cases import EDGE, SF, documents, edge, none


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def root_and_proofs(leaves, fanout):
    """The root and the siblings of each leaf, in a plain tree."""
    rows, proofs, at = leaves, [[] for _ in leaves], list(range(len(leaves)))
    while len(rows) > 1:
        for i, a in enumerate(at):
            b = a - a % fanout
            proofs[i].append((a % fanout, rows[b : a] + rows[a + 1 : b + fanout]))
        rows, at = [sha("".join(rows[b : b + fanout])) for b in range(0, len(rows), fanout)], [a // fanout for a in at]
    return rows[0], proofs


def brute(rows, fanout=2):
    """rows: doc_id, source, lang, n_chars, text."""
    by = {}
    for r in rows:
        by.setdefault(b"" if r[2] is None else b"=" + r[2].encode(), []).append(r)
    groups = {g: sorted(m, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for g, m in sorted(by.items())}
    trees = {g: root_and_proofs([leaf_of(r) for r in m], fanout) for g, m in groups.items()}
    root, above = root_and_proofs([t[0] for t in trees.values()], fanout)
    out = []
    for up, (g, members) in zip(above, groups.items(), strict=True):
        for r, own in zip(members, trees[g][1], strict=True):
            path = own + up
            odd = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf_of((*r[:3], r[3] + 1, r[4])) if odd else leaf_of(r)
            for place, others in path:
                h = sha("".join(others[:place] + [h] + others[place:]))
            out.append((r[0], leaf_of(r), trees[g][0], root, sha("".join(x for _, others in path for x in others)), h, h == root))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


TABLE = "doc_id long, source string, lang string, n_chars long, text string"


def made(n):
    langs = [None, "", "en", "en", "en", "é", "zz"]
    rows = [(i * 3, f"s{i % 4}" if i % 5 else None, langs[i % 7], i if i % 11 else None, f"text {i}" if i % 13 else None) for i in range(n)]
    return rows + [(None, None, None, None, None), (None, "", "", 0, ""), (2**61 + 1, "s", "en", 5, "x" * 150_000), (9, "s", "alone", 1, "a")] + rows[:3] * 2


@pytest.mark.parametrize(("fanout", "levels"), [(2, 8), (2, 1), (2, 2), (3, 2), (5, 1)])
def test_edges(spark, fanout, levels):
    rows = made(150)
    df = spark.createDataFrame(rows, TABLE).repartition(3).withColumnsRenamed({}).selectExpr("*", "1 AS at", "'x' AS grp", "2 AS nodes", "3 AS part", "4 AS leaf")
    assert rows_of(manifest.verify(df, fanout, levels)) == brute(rows, fanout)


def test_small_tables(spark):
    assert rows_of(manifest.verify(spark.createDataFrame([], TABLE))) == []
    for rows in ([(5, "a", "en", 1, "t")], [(5, "a", "en", 1, "t"), (6, "a", "de", 1, "t")], [(None,) * 5] * 3):
        assert rows_of(manifest.verify(spark.createDataFrame(rows, TABLE))) == brute(rows)
    plain = edge(spark).selectExpr("doc_id", "source", "'en' AS lang", "1L AS n_chars", "text")
    assert rows_of(manifest.verify(plain)) == brute([(d, "s", "en", 1, t) for d, t in EDGE])
    assert none(spark).count() == 0


def test_one_hot_group_in_many_buckets(spark):
    rows = [(i, "s", "en" if i % 50 else "de", i, f"t{i}") for i in range(5000)]
    df = spark.createDataFrame(rows, TABLE).repartition(6)
    got = manifest.row_proofs(df, 2, 3)
    assert got.groupBy("grp").count().count() == 2 and got.select("root").distinct().count() == 1
    assert rows_of(manifest.verify(df, 2, 3)) == brute(rows)


def test_query_and_sql(spark):
    docs = documents()[["doc_id", "source", "lang", "n_chars", "text"]]
    got = rows_of(queries.op13_merkle_manifest(spark, SF))
    assert got == brute([tuple(r) for r in docs.astype(object).values.tolist()])
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = c.sql(queries.oracle_sql()["op13_merkle_manifest"]).df()
    assert got == sorted(map(tuple, df[["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]].values.tolist()), key=repr)
