import itertools
import random

import numpy as np

from neargrid.llm import order_minhash as om
from neargrid.llm import queries
from neargrid.llm.words import Words

from .cases import EDGE, SF, documents, edge, none


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_is_the_edit_distance_within_the_band():
    r = random.Random(1)
    for _ in range(600):
        a = [r.randrange(4) for _ in range(r.randrange(1, 30))]
        b = [r.randrange(4) for _ in range(r.randrange(30))] if r.random() < 0.3 else [x for x in a if r.random() > 0.1]
        want, most = len(a) + len(b) - 2 * lcs(a, b), r.randrange(20)
        assert om.alignment(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), most) == min(want, most + 1)


def brute(rows):
    """Classes from the comparison of all pairs that share a shingle."""
    words = Words([t for _, t in rows])
    texts = {d: om.shingles(words.hashes[words.bounds[i] : words.bounds[i + 1]]) for i, (d, _) in enumerate(rows) if d is not None}
    parent = {d: d for d in texts}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {d: set(s.tolist()) for d, s in texts.items()}
    for a, b in itertools.combinations(sorted(texts), 2):
        if (sets[a] & sets[b] or not sets[a] and not sets[b]) and om.alike(texts[a], texts[b]):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {d: top(d) for d in texts}


def result(df):
    return {r.doc_id: r.class_id for r in df.collect()}


def test_query(spark):
    docs = documents()
    assert result(queries.op2_order_minhash(spark, SF)) == brute([*zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)])


def test_edges(spark):
    assert result(om.near_duplicates(edge(spark))) == brute(EDGE)
    assert om.near_duplicates(none(spark)).collect() == []
    kept = om.keep_one(edge(spark))
    assert kept.columns == edge(spark).columns
    assert {r.doc_id for r in kept.collect()} == {None, *brute(EDGE).values()}


def test_chains_of_edits(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, n = [], 0
    for size in (40, 5, 2, 1):
        text = [word() for _ in range(200)]
        for _ in range(size):
            rows.append((n, " ".join(text)))
            n += 1
            text = [*text]
            text[r.randrange(200)] = word()
    rows.append((n, " ".join(reversed(rows[0][1].split()))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(om.near_duplicates(df)) == brute(rows)


def template_group(groups: int = 100, seed: int = 5):
    """Texts that share a template (340 of 400 words) and are less than 0.8 alike; each has a copy with edits elsewhere that is
    0.8 alike by a narrow margin, and ids say nothing of who belongs to whom."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    template = [word() for _ in range(340)]
    texts = []
    for _ in range(groups):
        text = template[:170] + [word() for _ in range(60)] + template[170:]
        for c in range(2):
            copy = [*text]
            for k in range(4):
                copy[10 + 95 * k + 12 * c] = word()
            texts.append(" ".join(copy))
    r.shuffle(texts)
    return [*enumerate(texts)]


def test_template_group_against_brute_force(spark):
    rows = template_group()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert len(set(want.values())) == 100
    assert result(om.near_duplicates(df)) == want


def test_all_members_stay_candidates():
    # a, b, c are one class and d is alike to c only; e shares no more than a template with any of them
    chain = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 8, 16, 24)] + [np.concatenate([np.arange(60), np.arange(500, 540)]).astype(np.uint64)]
    at = np.arange(5)
    assert om.links_between(chain, [0, 0, 0, 3, 4], at, at) == [(2, 3)]
    common = om.shared_shingles(chain, at[:2], at[2:])
    assert common.tolist() == [[84, 76, 60], [92, 84, 52]]


def test_rows_of_one_id_are_compared_with_all_its_texts(spark):
    r = random.Random(11)
    a, b = ([f"{x}{r.randrange(10**6)}" for _ in range(120)] for x in "ab")
    near = lambda t: " ".join([*t[:60], "new", *t[61:]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b))]
    found = {tuple(sorted(map(tuple, om.near_duplicates(spark.createDataFrame(some, "doc_id long, text string").repartition(n)).collect()))) for n in (1, 4) for some in (rows, rows[::-1])}
    assert found == {((1, 1), (1, 1), (2, 1), (3, 1))}


def test_all_links_of_the_documents_are_found(spark):
    docs = documents()
    words = Words(docs.text.tolist())
    own = [om.shingles(words.hashes[a:b]) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
    at = np.arange(len(own))
    got = {r.doc_id: r.class_id for r in om.near_duplicates(spark.createDataFrame(docs[["doc_id", "text"]])).collect()}
    links = om.links_between(own, at.tolist(), at, at)
    ids = docs.doc_id.tolist()
    assert links and all(got[ids[x]] == got[ids[y]] for x, y in links)
