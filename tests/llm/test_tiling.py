import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from neargrid.llm import queries, tiling

from .cases import SF, documents, edge, none

import pandas as pd
import re


def plain_tiles(a, b, least):
    """Greedy string tiling as defined: mark one longest common unmarked run after another."""
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return tiles
        tiles.append((n, i, j))
        free_a[i : i + n], free_b[j : j + n] = [False] * n, [False] * n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), min_size=2, max_size=20))
def test_tiles_are_common_and_apart(a, b):
    x, y = np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)
    tiles = tiling.greedy_tiles(x, y, 2)
    used_a, used_b = set(), set()
    for n, i, j in tiles:
        assert n >= 2 and a[i : i + n] == b[j : j + n]
        assert not used_a & {*range(i, i + n)} and not used_b & {*range(j, j + n)}
        used_a |= {*range(i, i + n)}
        used_b |= {*range(j, j + n)}
    want = plain_tiles(a, b, 2)
    assert tiles == want


def test_query_finds_the_passages(spark):
    docs, items = documents(), pd.read_parquet(f"{SF}/benchmark.parquet")
    flat = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    texts = {d: flat(t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    want = {(d, i) for i, t in zip(items.item_id, items.text, strict=True) for d, x in texts.items() if flat(t) in x}
    got = {(r.doc_id, r.item_id) for r in queries.op9_greedy_string_tiling(spark, SF).collect()}
    assert want and want <= got
    left = {r.doc_id for r in tiling.decontaminate(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert left == set(docs.doc_id.tolist()) - {d for d, _ in got}


def test_reordered_edge_and_empty(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    half = item.split()
    rows = [(1, "start " + " ".join(half[6:]) + " middle words " + " ".join(half[:6]).upper()), (2, "alpha beta gamma delta x " * 4), (3, None), (4, ""), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "", 1), (10, "x alpha", 1)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): (r.coverage, r.n_tiles) for r in tiling.leaks(docs, bench).collect()}
    assert got == {(1, 7): (1.0, 2), (None, 7): (1.0, 1), (2, 10): (1.0, 1)}
    many = {(r.doc_id, r.item_id): (r.coverage, r.n_tiles) for r in tiling.leaks(docs, bench, block_bytes=40).collect()}
    assert many == got
    assert tiling.leaks(none(spark), bench).collect() == [] == tiling.leaks(docs, bench.limit(0)).collect()
    assert tiling.leaks(edge(spark), bench).collect() == []


def test_query_equals_plain_tiling(spark):
    docs, items = documents(), pd.read_parquet(f"{SF}/benchmark.parquet")
    lower = lambda t: re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: chr(ord(m[0]) + 32), t)
    cut = lambda t: re.findall("[0-9a-z_\u0080-\U0010ffff]+", lower(t or ""))
    seeds = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    texts = {d: cut(t) for d, t in zip(docs.doc_id.tolist(), docs.text, strict=True)}
    known = {d: seeds(w) for d, w in texts.items()}
    want = {}
    for i, t in zip(items.item_id.tolist(), items.text, strict=True):
        own = cut(t)
        for d, w in texts.items():
            if seeds(own) & known[d]:
                near = [any(tuple(w[k : k + 5]) in seeds(own) for k in range(max(0, j - 4), j + 1)) for j in range(len(w))]
                at = [j for j in range(len(w)) if near[j] or (j and near[j - 1])]
                covered = sum(n for n, _, _ in plain_tiles([w[j] if near[j] else None for j in at], own, 5))
                if covered >= tiling.THRESHOLD * len(own):
                    want[d, i] = (covered, len(own))
    got = {(r.doc_id, r.item_id): (r.matched_words, r.item_words) for r in queries.op9_greedy_string_tiling(spark, SF).collect()}
    assert got == want
