import hashlib
import random

import numpy as np

from neargrid.llm import deep_shallow, queries, repeats

from .cases import EDGE, SF, documents, edge, none


def brute(rows):
    """Every string of 100 bytes, in order of doc_id (null first) and start."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        d, t = rows[i]
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=np.int64)
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s] += 1
                gone[s + 100 if s + 100 < len(gone) else -1] -= 1
            else:
                seen.add(w)
        on = np.cumsum(gone[:-1]) > 0
        rest = np.frombuffer(b, np.uint8)[~on].tobytes()
        runs = int((on & ~np.append(False, on[:-1])).sum())
        out.append((d, len(b), int(on.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_deep_shallow_order():
    r = random.Random(5)
    for _ in range(30):
        n = r.randrange(1, 60)
        base = bytes(r.randrange(3) for _ in range(48))
        rows = [bytearray(base) for _ in range(n)]
        for x in rows:
            for _ in range(r.randrange(3)):
                x[r.randrange(48)] = r.randrange(4)
        groups = np.array([r.randrange(3) for _ in range(n)])
        m = np.array([list(x) for x in rows], dtype=np.uint8)
        order, shared = deep_shallow.deep_shallow(m, groups)
        keys = [(int(groups[i]), bytes(rows[i])) for i in order]
        assert keys == sorted(keys)
        for k in range(n):
            if k == 0 or keys[k][0] != keys[k - 1][0]:
                assert shared[k] == -1
            else:
                a, b = keys[k][1], keys[k - 1][1]
                assert shared[k] == next((j for j in range(48) if a[j] != b[j]), 48)


def test_query(spark):
    docs = documents()
    assert rows_of(queries.op3_deep_shallow_repeats(spark, SF)) == brute([*zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)])


def test_edge_and_empty(spark):
    assert rows_of(repeats.remove_repeats(edge(spark).coalesce(1))) == brute(EDGE)
    assert repeats.remove_repeats(none(spark)).collect() == []


def test_shared_passages(spark):
    r = random.Random(2)
    passages = ["".join(r.choice("ab cé") for _ in range(r.randrange(90, 260))) for _ in range(6)]
    rows = [(i * 7 % 101, "".join(r.choice([r.choice(passages), r.choice(passages)[r.randrange(50) :], "".join(r.choice("xyz") for _ in range(r.randrange(80)))]) for _ in range(5))) for i in range(101)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(repeats.remove_repeats(df)) == brute(rows)
    left = {r.doc_id: r.kept for r in repeats.remove_repeats(df, texts=True).collect()}
    assert {hashlib.sha256(bytes(x)).hexdigest() for x in left.values()} == {x[4] for x in brute(rows)}


def test_hot_anchors_go_by_window(spark):
    r = random.Random(8)
    line = "".join(r.choice("abcdefgh ") for _ in range(70))
    long = "".join(r.choice("stuvwxyz ") for _ in range(230))
    rows = [(i, "".join(r.choice("0123456789") for _ in range(90)) + line + "".join(r.choice("0123456789") for _ in range(90)) + long * (i % 3)) for i in range(60)]
    rows += [(i + 60, rows[i % 7][1][i : i + 190]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(repeats.remove_repeats(df, hot=3, salts=2)) == brute(rows)


def test_long_texts_cross_blocks(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, "".join(r.choice(["lorem ", "ipsum ", "dolor\n", "sit ", "amet "]) for _ in range(r.randrange(900)))) for i in range(12)]
    monkeypatch.setattr(repeats, "STEP", 256)
    texts = [t.encode() for _, t in rows]
    small = repeats.Anchors(texts)
    monkeypatch.setattr(repeats, "STEP", 1 << 18)
    whole = repeats.Anchors(texts)
    # equal windows have equal anchors at equal places, however the texts are cut into blocks
    for name in ("at", "low", "high", "doc", "hashes"):
        assert np.array_equal(getattr(small, name), getattr(whole, name)), name
    assert rows_of(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_numbers_of_chunks_are_not_bounded():
    text = bytes(range(32, 127)) * 4
    anchors, chunk = repeats.Anchors([text, text]), (50_000 << 32) + 7
    items = anchors.items(np.arange(len(anchors.at)), np.array([5, 6]), chunk)
    spans = repeats.spans_of(items, *repeats.lost_windows(items))
    assert set(spans[:, 0].tolist()) == {chunk} and spans[spans[:, 1] == 1][:, 3].max() == len(text)
