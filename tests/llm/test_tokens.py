import zlib

import numpy as np
import pytest

from neargrid.llm import packing, queries, rans, token_counts, token_output
from neargrid.llm.encoding import PieceEncoder, tokenizer

from .cases import EDGE, SF, documents, edge, none


def plain(name, texts):
    return [x.ids for x in tokenizer(name).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    texts = [t for _, t in EDGE] + documents().text.tolist() + ["x \ny", "x\n y", " a", "\t a", "   x", "\x1c x", "ᄀ ᅡ", "x́ ́y", "a \n\n  b", "İ İ", "a.b,c ,d;: e.\u0338 é. l'.x l'll!s", "x.<|endoftext|>.y", " ß, ªº. x²;"]
    encoder = PieceEncoder(name, cache_pieces=500)
    want = plain(name, texts)
    for a in range(0, len(texts), 50):
        ids, lengths = encoder.encode(texts[a : a + 50])
        assert lengths.tolist() == [len(x) for x in want[a : a + 50]]
        assert ids.tolist() == [i for x in want[a : a + 50] for i in x]
        assert encoder.count_ids([(t or "").encode() for t in texts[a : a + 50]]).tolist() == lengths.tolist()


def test_pieces_that_share_a_hash_are_encoded_apart(monkeypatch):
    monkeypatch.setattr("neargrid.llm.encoding.RunHashes.of", lambda self, a, b: (b - a).astype(np.uint64) % np.uint64(7))
    texts = documents().text.tolist()[:40]
    ids, lengths = PieceEncoder("byte_bpe_50k.json").encode(texts)
    want = plain("byte_bpe_50k.json", texts)
    assert ids.tolist() == [i for x in want for i in x] and lengths.tolist() == [len(x) for x in want]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_random_texts_are_cut_safely(name):
    rng = np.random.default_rng(3)
    marks = list("ab Z.,;:!?'\n\t -9<|>éñ\u0301\u00a0\u2003世") + ["'s", "'ll", "<|endoftext|>", "..."]
    texts = ["".join(rng.choice(marks, rng.integers(0, 40))) for _ in range(2000)]
    ids, lengths = PieceEncoder(name, cache_pieces=300).encode(texts)
    want = plain(name, texts)
    assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 300_000])
def test_rans_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.2, n) % 50_257).astype(np.uint16)
    coder = rans.Coder(rans.frequencies(np.bincount(ids, minlength=1 << 16)))
    block = coder.encode(ids, np.array([n]))
    got, lengths = coder.decode(block)
    assert np.array_equal(got, ids) and lengths.tolist() == [n]
    broken = bytearray(block)
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        coder.decode(bytes(broken))


def token_rows(rows):
    """Brute force of the token output: doc_id, start, n_tokens, crc."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for (d, _), ids in zip(rows, plain("byte_bpe_50k.json", [t for _, t in rows]), strict=True):
        ids = [*ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_output_edge(spark):
    got = [tuple(r) for r in token_output.token_ids(edge(spark)).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(token_rows(EDGE), key=key)
    assert token_output.token_ids(none(spark)).collect() == []


def test_token_output_query(spark):
    docs = documents()
    got = sorted(tuple(r) for r in queries.op1_rans_token_output(spark, SF).collect())
    assert got == token_rows(zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True))


def test_token_counts(spark):
    docs = documents()
    rows = [*zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)]
    for df, some in ((queries.op10_token_counts(spark, SF), rows), (token_counts.count_tokens(edge(spark), batch_bytes=1000), EDGE)):
        want = [(d, len((t or "").encode()), len(i), len(i) > 2048) for (d, t), i in zip(some, plain("word_bpe_49k.json", [t for _, t in some]), strict=True)]
        key = lambda r: (r[0] is None, r[0] or 0)
        assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(none(spark)).collect() == []


def check_packing(got, rows):
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    want = []
    for (d, _), ids in zip(rows, plain("byte_bpe_50k.json", [t for _, t in rows]), strict=True):
        ids, at = [*ids, 0], 0
        for k, n in enumerate(packing.cut_lengths(len(ids), 2048)):
            want.append((d, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences), -(-sum(r.length for r in got) // 2048)


def test_packing(spark):
    docs = documents()
    rows = [*zip(docs.doc_id.tolist(), docs.text.tolist(), strict=True)]
    made, least = check_packing(queries.op6_pattern_packing(spark, SF).collect(), rows)
    assert made <= 1.1 * least
    check_packing(packing.pack(edge(spark)).collect(), EDGE)
    assert packing.pack(none(spark)).collect() == []


def test_plan_uses_every_piece_once():
    hist = np.bincount(np.random.default_rng(3).integers(1, 2049, 50_000), minlength=2049)
    p = packing.plan(hist)
    assert p["n_sequences"][0] <= 1.01 * -(-(hist * np.arange(2049)).sum() // 2048)
