import hashlib

import duckdb
import pytest

from neargrid.llm import line_dedup, queries

from .cases import EDGE, SF, documents, edge, none


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows, min_chars=10):
    """Id, lines, dropped lines and digest of each row, with a table of holders."""
    place = lambda d: (d is None, d or 0)
    first = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            first[key(line)] = min(first.get(key(line), place(d)), place(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or first[key(x)] == place(d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


SHARED = [
    (10, "First shared line\nonly mine here, ten\nshort"),
    (11, "  fIRST SHARED LINE\t\r\nshort\nfirst shared line"),
    (12, None),
    (13, "\n\n\n"),
    (13, "first shared line\nÉtÉ ÀÀÀÀÀÀ\nnine char"),
    (14, "étÉ ÀÀÀÀÀÀ\nÉtÉ ÀÀÀÀÀÀ\nnine char\nonly mine here, ten\n"),
    (None, "no id holds this line\nfirst shared line"),
    (None, "no id holds this line"),
    (15, "\n".join(f"numbered line {i}" for i in range(1000))),
    (16, "\n".join(f"numbered line {i}" if i % 130 else f"new in sixteen {i}" for i in range(1000))),
    (17, " first shared line"),
    (2, "x" * 200_000 + "\ny"),
    (3, "x" * 200_000 + "\ny\nFirst shared line "),
]


def test_edges(spark):
    assert rows_of(line_dedup.line_report(edge(spark))) == brute(EDGE)
    assert rows_of(line_dedup.line_report(none(spark))) == []
    rows = SHARED + SHARED[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for least in (1, 10, 18):
        assert rows_of(line_dedup.line_report(df, least)) == brute(rows, least)


def test_hot_lines(spark):
    rows = [(i, f"a line that all documents hold\nown line of document {i // 2}\n" + ("seldom repeated " + str(i % 7)) * (i % 3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(line_dedup.line_report(df)) == brute(rows)
    lines = line_dedup.line_table(df)
    hot = {tuple(r) for r in line_dedup.hot_firsts(lines, 4).collect()}
    named = lines.sparkSession.sql("SELECT xxhash64('a line that all documents hold') AS a, xxhash64(1, 'a line that all documents hold') AS b").first()
    assert (named.a, named.b, 0) in hot and len(hot) <= 16


def test_bitmaps_leave_out_words_that_stay(spark):
    rows = [(1, "line number three hundred"), (2, "\n".join("line number three hundred" if i == 300 else f"own line {i:09}" for i in range(400)))]
    maps = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(m.doc_id, [(w.word, w.bits) for w in m.words]) for m in maps] == [(2, [(300 // 64, ~(1 << 300 % 64))])]


def test_texts(spark):
    df = spark.createDataFrame([(d, t, "kept", i) for i, (d, t) in enumerate(SHARED)], "doc_id long, text string, word string, bits int")
    got = line_dedup.deduplicate(df)
    assert got.columns == df.columns
    digests = sorted((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest(), r.word) for r in got.collect() if r.doc_id)
    assert digests == sorted((r[0], r[3], "kept") for r in brute(SHARED) if r[0])
    assert {r.bits: r.text for r in got.collect()}[2] is None


def test_query_and_sql(spark):
    docs = documents()
    got = rows_of(queries.op12_line_dedup(spark, SF))
    assert got == brute([*zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)])
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = c.sql(queries.oracle_sql()["op12_line_dedup"]).df()[["doc_id", "n_lines", "n_dropped", "kept_sha256"]]
    assert got == sorted(map(tuple, df.values.tolist()), key=repr)


def test_plan_has_no_python(spark, capsys):
    line_dedup.line_report(spark.read.parquet(f"{SF}/documents.parquet")).explain("formatted")
    assert not any(x in capsys.readouterr().out for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("gaps", [[0], [3], [0, 1, 2], [1, 5, 6, 9]])
def test_unpacked(spark, gaps):
    df = spark.createDataFrame([([(w, w * 10) for w in gaps],)], "words array<struct<word:int,bits:bigint>>")
    assert df.select(line_dedup.unpacked(df["words"])).first()[0] == [w * 10 if w in gaps else -1 for w in range(max(gaps) + 1)]
