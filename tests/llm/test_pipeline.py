import re

import numpy as np
import pandas as pd

import corpus_pipeline

from neargrid.llm import order_minhash
from neargrid.llm.words import Words

from .cases import SF, edge
from .test_tokens import check_packing


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, apply) in enumerate(corpus_pipeline.STAGES):
        out = apply(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == columns and 0 < out.count() <= before, name
            before, docs = out.count(), out
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    made, least = check_packing(out.collect(), rows)
    assert made >= least
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.drop("sequence_id", "offset").collect())) == sorted(map(tuple, out.drop("sequence_id", "offset").collect()))


def test_edge_rows_pass(spark):
    docs = edge(spark)
    for _, apply in corpus_pipeline.STAGES[:-1]:
        docs = apply(spark, docs, SF).persist()
        assert docs.columns == edge(spark).columns
    # one of the two equal texts, of the empty ones, and of the repeated rows
    ids = [r.doc_id for r in docs.collect()]
    assert len(ids) == len(set(ids)) and {None, 1, 6, 7, 8, 9} <= set(ids) and len({3, 4, 5} & set(ids)) == 1
    assert np.all([r.length > 0 for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()])


def planted_tables():
    """documents, labels and benchmark with toxic documents, exact and near copies and leaks; and the toxic ids."""
    r = np.random.default_rng(12)
    words = np.array([f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnprstvz"])
    item = [" ".join(r.choice(words, 40)) for _ in range(5)]
    texts, toxic = {}, set()
    for d in range(240):
        text = list(r.choice(words, 90))
        if d % 6 == 0:
            toxic.add(d)
            for w in r.choice(["vile", "nasty", "Foul", "grim"], 6):
                text.insert(int(r.integers(90)), w)
        texts[d] = " ".join(text)
    clean = [d for d in texts if d not in toxic]
    for k, d in enumerate(clean[:30]):  # exact copies but for white space: some are longer than the first text
        texts[300 + k] = texts[d].replace(" ", "  ", 4) if k % 2 else texts[d]
    for k, d in enumerate(clean[40:80]):  # near copies, of copies too
        text = texts[d].split(" ")
        text[int(r.integers(90))] = "changed"
        texts[400 + k] = " ".join(text)
    for k, d in enumerate(clean[100:110]):
        texts[d] += " " + item[k % 5]
    docs = pd.DataFrame({"doc_id": list(texts), "text": list(texts.values())})
    docs["lang"], docs["source"], docs["n_chars"] = "en", "src1", docs.text.str.len()
    labels = pd.DataFrame({"doc_id": [d for d in range(240)], "quality": 1, "toxic": [int(d in toxic) for d in range(240)]})
    return docs, labels, pd.DataFrame({"item_id": range(5), "text": item}), toxic


def brute_kept(docs, items, toxic):
    """Ids that stay after all filters, from their definitions and all pairs."""
    left = [(d, t) for d, t in zip(docs.doc_id.tolist(), docs.text, strict=True) if d not in toxic]
    groups = {}
    for d, t in left:
        groups.setdefault(re.sub(r"\s", "", t), []).append((-len(t), d, t))
    left = sorted((d, t) for g in groups.values() for _, d, t in [min(g)])
    cut = Words([t for _, t in left])
    own = [order_minhash.shingles(cut.hashes[a:b]) for a, b in zip(cut.bounds[:-1], cut.bounds[1:], strict=True)]
    top = list(range(len(left)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(left)):
        for j in range(i):
            if order_minhash.alike(own[i], own[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    left = [x for i, x in enumerate(left) if top[i] == i]
    return {d for d, t in left if not any(x in t for x in items.text)}


def test_run_keeps_what_brute_force_keeps(spark, tmp_path):
    docs, labels, items, toxic = planted_tables()
    for name, table in (("documents", docs), ("labels", labels), ("benchmark", items)):
        table.to_parquet(tmp_path / f"{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute_kept(docs, items, toxic)
    assert {r.doc_id for r in out} == want and len(want) < 200
    check_packing(out, [(d, t) for d, t in zip(docs.doc_id.tolist(), docs.text, strict=True) if d in want])
