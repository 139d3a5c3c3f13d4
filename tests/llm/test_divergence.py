import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from neargrid.llm import divergence, queries

from .cases import EDGE, SF, documents, edge

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, min_docs=3, top=200):
    """rows: lang, source, text."""
    counts, holders, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, own = lang or "", source or "", [low(t) for t in TERM.findall(text or "")]
        groups[lang].add(source)
        counts[lang, source].update(own)
        holders[lang].update(set(own))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in holders[lang].items() if n >= min_docs]
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(h, sum(f(p[s][t], p[h][t]) for t in kept)) for h in sources if h != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def made(n=400, seed=3):
    rng = np.random.default_rng(seed)
    words = ["Alpha", "beta", "gAmma", "été", "naïve", "日本", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))]
    rows = []
    for i in range(n):
        lang = ["en", "de", None, "x"][min(3, int(rng.integers(0, 8)) % 5)]
        source = None if i % 17 == 0 else ["hot", f"s{rng.integers(0, 5)}"][int(rng.random() < 0.6)]
        rows.append((lang, source, " ".join(words[int(w)] for w in rng.zipf(1.4, int(rng.integers(0, 30))) % len(words)) + "-3rd 5x" * (i % 2)))
    return rows + [("en", "empty", ""), ("en", "null", None), ("lone", "only", "a b c"), ("none", "a", "q"), ("none", "b", "r"), ("none", "c", None)] + rows[:20] * 2


SCHEMA = "lang string, source string, text string"


def test_edges(spark, monkeypatch):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "'x' AS term", "1 AS n", "2 AS m", "3 AS value", "4 AS rank", "5 AS doc_id")
    want = brute(rows)
    assert rows_of(divergence.audit(df)) == want
    assert rows_of(divergence.audit(df, min_docs=1, top=7)) == brute(rows, 1, 7)
    assert {r[:5] for r in want if r[0] == "none"} == {("none", a, "pair", b, 0) for a in "abc" for b in "abc" if a != b}
    assert rows_of(divergence.audit(spark.createDataFrame([], SCHEMA))) == []
    # small blocks, slices and tables give the same
    for name, value in (("ENTRIES", 40), ("SLICE", 2), ("PAIRS", 16), ("TABLE", 30), ("BLOCK", 7)):
        monkeypatch.setattr(divergence, name, value)
    assert rows_of(divergence.audit(df)) == want


def test_edge_texts(spark):
    df = edge(spark).selectExpr("'en' AS lang", "concat('s', coalesce(doc_id, 0) % 3) AS source", "text")
    assert rows_of(divergence.audit(df, 1)) == brute([("en", f"s{(d or 0) % 3}", t) for d, t in EDGE], 1)


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    counts, extra = rng.integers(0, 1 << 52, 2000), rng.integers(1, 1 << 52, 2000)
    got = divergence.shares(counts, counts + extra)
    assert got.tolist() == [1 + 10**9 * (c + 1) // (c + x) for c, x in zip(counts.tolist(), extra.tolist(), strict=True)]


def test_equal_columns_are_one(spark):
    rows = [("en", f"s{i % 2}", f"common {'abcdefgh'[i % 8]}x") for i in range(64)]
    terms = divergence.kept_terms(spark.createDataFrame(rows, SCHEMA))
    assert terms.count() == 9 and sorted(r.times for r in divergence.columns_of(terms).collect()) == [1, 4, 4]


def test_query_and_sql(spark):
    docs = documents()
    got = rows_of(queries.op11_source_divergence(spark, SF))
    assert got == brute([*zip(docs.lang, docs.source, docs.text, strict=True)])
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = c.sql(queries.oracle_sql()["op11_source_divergence"]).df()
    assert got == sorted(map(tuple, df[["lang", "source", "part", "item", "value", "rank"]].values.tolist()))
