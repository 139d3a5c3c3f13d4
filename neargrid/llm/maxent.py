r"""A hashed maximum-entropy language model with a class-factored softmax.

Tokens are runs of bytes other than space and 09-0D, with A-Z in lower case, and one end token for each document. The
model gives each token log P(class | before) + log P(token | class, before):

* Classes: each of the `SINGLES` most frequent words is one, so that features choose between these words themselves; the others
  go by frequency (bins of the `HEAD` most frequent words; all others) and by their first character beyond ASCII; the end.
  P(class | before) is a softmax over hashed features: the word before (n-gram), the word two before (skip), and the
  classes of the three words before. Weights are trained by gradient steps over minibatches in each task, and averaged over
  tasks by how often each feature occurred.
* Within a class of many words, P is the smoothed share c + 0.1 of the class, times e**weight for a word equal to one of the three
  before (skip features), divided by the sum of this over the class, which differs from 1 for these three words only.
  Their weights come from one step of iterative scaling.

Both factors sum to one over the vocabulary and one unknown word for each class, so P is a distribution.

1. Documents are stored in chunks, one row each, so that no file split cuts a chunk in two. Each chunk sends its distinct words with their counts, packed by buckets; buckets add
   them up (over all training documents), and return to each chunk the counts of its words in the order it sent them.
2. The driver gets the `HEAD` most frequent words and sums for each class: both have fixed sizes.
3. Weights are trained where chunks are read; one block of features after another is averaged.
4. Chunks and their words' counts meet by chunk number, and are scored in sparse numpy batches.

Words are told apart by 64-bit hashes. Null texts are empty: one end token. Documents without an id are learnt from. Rows
with one doc_id twice count twice. Empty tables give no rows. Without training documents all words are unknown.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RunHashes, mix64, ragged, stage, task_count
from .repeats import _packed, unpacked
from .repeats import packed_chunks as chunked

HEAD = 1 << 14
#: Text whose words are counted in one bucket.
BUCKET_BYTES = 16 << 20
#: Words that are classes of their own.
SINGLES = 28
#: Rank at which each frequency bin of the rest of the head ends.
BINS = np.array([64, 256, 1024, 4096, HEAD])
SIGNS = 4
END_CLASS = SINGLES + (len(BINS) + 1) * SIGNS
CLASSES = 56  # some stay empty, so that rows end with a cache line
SLOTS = 1 << 15
BLOCK = 1 << 10
BATCH = 8192
RATE = 0.3
ADD = 0.1
DISTANCES = 3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
SENT = np.dtype([("hash", "<u8"), ("n", "<u8"), ("sign", "u1")])


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def _tables(batches):
    """The number and the documents of each chunk."""
    for batch in batches:
        for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
            yield chunk, unpacked(data.as_py())


class Tokens:
    """Tokens of a chunk: `of` numbers the distinct words (their number: the end), document after document."""

    def __init__(self, table: pa.Table):
        if "nth" in table.column_names:
            table = table.sort_by("nth")
        self.names = table.column("doc_id").to_pylist()
        texts = table.column("text").to_pylist()
        offsets = ragged([len(x) + 1 for x in texts])
        data = _LOWER[np.frombuffer(b" ".join(texts) + b" " if texts else b"", dtype=np.uint8)]
        on = ~_SPACE[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        hashes, first, inverse = np.unique(RunHashes(data).of(starts, ends), return_index=True, return_inverse=True)
        self.hashes, self.sign = hashes, self._signs(data, starts[first], ends[first])
        bounds = np.searchsorted(starts, offsets)
        self.sizes = np.diff(bounds) + 1
        self.bounds = ragged(self.sizes)
        self.of = np.full(self.bounds[-1], len(hashes), dtype=np.int64)
        place = np.ones(self.bounds[-1], dtype=bool)
        place[self.bounds[1:] - 1] = False
        self.of[place] = inverse
        self.train = np.array([not held_out(x) for x in self.names], dtype=bool)

    @staticmethod
    def _signs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """0 for ASCII words, else 1 to 3 by the last byte of the first character beyond ASCII."""
        wide = np.append(np.flatnonzero(data >= 0xC0), len(data))
        at = wide[np.searchsorted(wide, starts)]
        last = np.append(data, np.zeros(2, dtype=np.uint8))[np.minimum(at + 1, len(data))]
        return np.where(at < ends, 1 + last % (SIGNS - 1), 0).astype(np.uint8)

    def counts(self) -> np.ndarray:
        """How often each distinct word occurs in training documents."""
        weights = np.repeat(self.train, self.sizes)
        return np.bincount(self.of[weights], minlength=len(self.hashes) + 1)[:-1]

    def before(self, d: int) -> np.ndarray:
        """The token d places before each; -1 ahead of the document's start."""
        out = np.full(len(self.of), -1, dtype=np.int64)
        out[d:] = self.of[:-d] if d < len(self.of) else out[d:]
        for j in range(d):
            at = self.bounds[:-1] + j
            out[at[at < self.bounds[1:]]] = -1
        return out


def class_of(rank, sign):
    """The class of a word by its rank and sign."""
    return np.where(rank < SINGLES, rank, SINGLES + np.searchsorted(BINS, rank, side="right") * SIGNS + sign)


class Model:
    """Fixed-size parameters: the head's words, sums of each class, weights of feature slots and of repeated words."""

    def __init__(self, head: np.ndarray, words: np.ndarray, kinds: np.ndarray):
        """head: sorted hashes with their ranks and counts; words, kinds: tokens and distinct words of each class."""
        self.head, self.words, self.kinds = head, words, kinds
        self.bias = np.log((words + 0.5) / (words + 0.5).sum()).astype(np.float32)
        self.bias[END_CLASS + 1 :] = -60
        self.weights = np.zeros((SLOTS, CLASSES), dtype=np.float32)
        self.again = np.zeros(DISTANCES)

    def classes(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Class of each distinct word (and of the end), and the training count of those in the head (else -1)."""
        k = np.minimum(np.searchsorted(self.head["hash"], t.hashes), max(0, len(self.head) - 1))
        hit = self.head["hash"][k] == t.hashes if len(self.head) else np.zeros(len(t.hashes), dtype=bool)
        rank = np.where(hit, self.head["rank"][k], HEAD) if len(self.head) else np.full(len(t.hashes), HEAD)
        kind = class_of(rank, t.sign)
        count = np.where(hit, self.head["n"][k], -1) if len(self.head) else np.full(len(t.hashes), -1)
        return np.append(kind, END_CLASS), np.append(count, 0)

    def features(self, t: Tokens, kind: np.ndarray) -> np.ndarray:
        """Three slots for each token."""
        past = [t.before(d) for d in (1, 2, 3)]
        names = np.append(t.hashes, np.zeros(2, dtype=np.uint64))  # the end and the start
        code = np.append(kind, CLASSES).astype(np.uint64)
        three = (code[past[0]] * np.uint64(64) + code[past[1]]) * np.uint64(64) + code[past[2]]
        mask = np.uint64(SLOTS - 1)
        return np.stack([mix64(names[past[0]], 21) & mask, mix64(names[past[1]], 22) & mask, mix64(three, 23) & mask], axis=1).astype(np.int64)

    def _scores(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the classes, the largest 0, and their exponentials; one row for each token."""
        z = np.take(self.weights, slots[:, 0], axis=0)
        z += np.take(self.weights, slots[:, 1], axis=0)
        z += np.take(self.weights, slots[:, 2], axis=0)
        z += self.bias
        z -= z.max(axis=1, keepdims=True)
        return z, np.exp(z)

    def class_logs(self, slots: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """log P(class | before) of the class of each token."""
        z, e = self._scores(slots)
        return z[np.arange(len(z)), kind] - np.log(e.sum(axis=1))

    def within(self, t: Tokens, kind: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Shares in the class; for each distance whether the token is repeated, and the repeated word's share (if it is
        of the token's class and not repeated nearer)."""
        share = (counts + ADD) / (self.words[kind] + ADD * (self.kinds[kind] + 1))
        share[-1] = 1.0
        share[kind < SINGLES] = 1.0
        same, mass, past = [], [], []
        for d in range(1, DISTANCES + 1):
            b = t.before(d)
            fresh = b >= 0
            for other in past:
                fresh &= b != other
            past.append(b)
            ok = fresh & (kind[b] == kind[t.of]) & (kind[t.of] != END_CLASS) & (kind[t.of] >= SINGLES)
            same.append(ok & (b == t.of))
            mass.append(np.where(ok, share[b], 0.0))
        return share, same, mass

    def logs(self, t: Tokens, counts: np.ndarray) -> np.ndarray:
        """log P of each token; counts: training counts of the distinct words."""
        kind, _ = self.classes(t)
        counts = np.append(counts, 0)
        share, same, mass = self.within(t, kind, counts)
        norm, bonus = np.ones(len(t.of)), np.zeros(len(t.of))
        for w, s, m in zip(self.again, same, mass, strict=True):
            norm += m * (np.exp(w) - 1)
            bonus += w * s
        out = np.log(share[t.of]) + bonus - np.log(norm)
        slots = self.features(t, kind)
        for a in range(0, len(slots), BATCH):
            own = slots[a : a + BATCH]
            out[a : a + BATCH] += self.class_logs(own, kind[t.of[a : a + BATCH]])
        return out

    def learn(self, t: Tokens, energy: np.ndarray, seen: np.ndarray) -> None:
        """Gradient steps over the training documents of a chunk."""
        kind, _ = self.classes(t)
        slots, target = self.features(t, kind), kind[t.of]
        use = np.flatnonzero(np.repeat(t.train, t.sizes))
        for a in range(0, len(use), BATCH):
            at = use[a : a + BATCH]
            own = slots[at]
            _, g = self._scores(own)
            g /= g.sum(axis=1, keepdims=True)
            g[np.arange(len(at)), target[at]] -= 1
            for j in range(3):
                column = own[:, j].astype(np.uint16)  # slots have 15 bits; short numbers are sorted by radix
                order = np.argsort(column, kind="stable")
                column = column[order]
                first = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
                slot = column[first].astype(np.int64)
                total = np.add.reduceat(np.take(g, order, axis=0), first, axis=0)
                energy[slot] += (total * total).sum(axis=1)
                seen[slot] += np.diff(np.append(first, len(column)))
                self.weights[slot] -= RATE * total / np.sqrt(energy[slot] + 1)[:, None].astype(np.float32)


def _sum_counts(held, head: int):
    """Counts of the words of a bucket, in the order in which each chunk sent them; its most frequent words; its sums."""
    parts = [np.frombuffer(d, SENT) for _, d, _ in held]
    rows = np.concatenate(parts)
    hashes, first, of = np.unique(rows["hash"], return_index=True, return_inverse=True)
    n = np.zeros(len(hashes), dtype=np.int64)
    np.add.at(n, of, rows["n"].astype(np.int64))
    back = n[of].astype("<u8")
    cut = ragged([len(p) for p in parts])
    kinds = pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64()
    names = ["chunk", "bucket", "data", "hash", "n", "sign", "kinds"]
    bucket = held[0][2]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([c for c, _, _ in held], [bucket] * len(held), [back[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], *[[None] * len(held)] * 4), kinds, strict=True)], names=names)
    sign = rows["sign"][first]
    top = np.lexsort((hashes, -n))[:head]
    top = top[n[top] > 0]
    m = len(top)
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([None] * m, [None] * m, [None] * m, hashes[top].view(np.int64), n[top], sign[top].astype(np.int32), [None] * m), kinds, strict=True)], names=names)
    per = [(int(n[sign == s].sum()), s, int(((sign == s) & (n > 0)).sum())) for s in range(SIGNS)]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([None] * 4, [None] * 4, [None] * 4, [None] * 4, [x[0] for x in per], [x[1] for x in per], [x[2] for x in per]), kinds, strict=True)], names=names)


def bucket_count(chunks: DataFrame) -> tuple[int, int]:
    """Buckets that words fall into by their hash, and tasks that share them."""
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = task_count(chunks.sparkSession, total)
    return max(tasks, -(-total // BUCKET_BYTES)), tasks


def count_words(chunks: DataFrame, n: int, tasks: int, head: int = HEAD) -> DataFrame:
    """Rows of three kinds: counts for a chunk (chunk set), frequent words (hash set), sums of a sign (kinds set)."""

    def send(batches):
        for chunk, table in _tables(batches):
            t = Tokens(table)
            rows = np.zeros(len(t.hashes), dtype=SENT)
            rows["hash"], rows["n"], rows["sign"] = t.hashes, t.counts(), t.sign
            yield _packed((rows["hash"] % np.uint64(n)).astype(np.int64), rows, chunk)

    sent = chunks.mapInArrow(send, "bucket long, chunk long, data binary")

    def run(batches):
        # like _together, but the bucket's number goes back with the counts
        now, held = None, []
        for batch in batches:
            for bucket, chunk, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and held:
                    yield from _sum_counts(held, head)
                    held = []
                now = bucket
                held.append((chunk, data, bucket))
        if held:
            yield from _sum_counts(held, head)

    ordered = sent.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return stage(ordered.mapInArrow(run, "chunk long, bucket long, data binary, hash long, n long, sign int, kinds long"))


def train(chunks: DataFrame, model: Model) -> None:
    """Set the model's weights from all training documents."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        model.weights = np.zeros((SLOTS, CLASSES), dtype=np.float32)
        energy, seen = np.zeros(SLOTS), np.zeros(SLOTS)
        hits, mass = np.zeros(DISTANCES), np.zeros(DISTANCES)
        for _, table in _tables(batches):
            t = Tokens(table)
            model.learn(t, energy, seen)
            kind, known = model.classes(t)
            _, same, share = model.within(t, kind, np.maximum(known, 1))
            use = np.repeat(t.train, t.sizes)
            hits += [s[use].sum() for s in same]
            mass += [m[use].sum() for m in share]
        blocks = []
        for b in range(0, SLOTS, BLOCK):
            own = slice(b, b + BLOCK)
            if seen[own].any():
                blocks.append((b // BLOCK, task, (model.weights[own] * seen[own, None]).astype("<f4").tobytes() + seen[own].astype("<f4").tobytes()))
        blocks.append((-1, task, np.concatenate([hits, mass]).astype("<f8").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*blocks, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "chunk", "data"])

    def add(batches):
        now, held = None, []

        def total():  # in order of the tasks, so that sums are the same every time
            kind = "<f4" if now >= 0 else "<f8"
            x = sum(np.frombuffer(d, kind).astype("<f8") for _, d in sorted(held, key=lambda x: x[0]))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["bucket", "data"])

        for batch in batches:
            for bucket, task, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and held:
                    yield total()
                    held = []
                now = bucket
                held.append((task, data))
        if held:
            yield total()

    parts = chunks.mapInArrow(run, "bucket long, chunk long, data binary")
    done = parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(add, "bucket long, data binary")
    weights = np.zeros((SLOTS, CLASSES), dtype=np.float32)
    for r in done.collect():  # SLOTS / BLOCK rows, and one
        x = np.frombuffer(r["data"], "<f8")
        if r["bucket"] < 0:
            hits, mass = x[:DISTANCES], x[DISTANCES:]
            model.again = np.log((hits + 1) / (mass + 1))
            continue
        sums, seen = x[: BLOCK * CLASSES].reshape(BLOCK, CLASSES), x[BLOCK * CLASSES :]
        weights[r["bucket"] * BLOCK : (r["bucket"] + 1) * BLOCK] = sums / np.maximum(seen, 1)[:, None]
    model.weights = weights


def fit(chunks: DataFrame, counted: DataFrame) -> tuple[Model, int, int]:
    """The model, and the number of training tokens and of distinct ones."""
    top = counted.where("hash IS NOT NULL").select("hash", "n", "sign").orderBy(F.desc("n"), "hash").limit(HEAD).collect()  # HEAD rows
    head = np.zeros(len(top), dtype=[("hash", "<u8"), ("rank", "<i8"), ("n", "<i8")])
    head["hash"] = np.array([r["hash"] for r in top], dtype=np.int64).view(np.uint64)
    head["rank"], head["n"] = np.arange(len(top)), [r["n"] for r in top]
    words, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    rest = SINGLES + len(BINS) * SIGNS
    for r in counted.where("kinds IS NOT NULL").groupBy("sign").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():
        words[rest + r["sign"]], kinds[rest + r["sign"]] = r["n"], r["kinds"]
    for rank, r in enumerate(top):
        k = int(class_of(rank, r["sign"]))
        words[k] += r["n"]
        kinds[k] += 1
        words[rest + r["sign"]] -= r["n"]
        kinds[rest + r["sign"]] -= 1

    def count_ends(batches):
        for _, table in _tables(batches):
            n = sum(not held_out(x) for x in table.column("doc_id").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    ends = chunks.mapInArrow(count_ends, "n long").agg(F.sum("n")).first()[0] or 0
    words[END_CLASS], kinds[END_CLASS] = ends, min(ends, 1)
    model = Model(np.sort(head, order="hash"), words, kinds)
    train(chunks, model)
    return model, int(words.sum()), int(kinds.sum())


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    chunks = stage(chunked(docs), codec="uncompressed")
    n_buckets, tasks = bucket_count(chunks)
    counted = count_words(chunks, n_buckets, tasks)
    model, n, v = fit(chunks, counted)
    ends = int(model.words[END_CLASS])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some megabytes, whatever the input

    def one(key, left: pa.Table, right: pa.Table) -> pa.Table:
        t = Tokens(unpacked(left.column("data")[0].as_py()))
        right = right.sort_by("bucket")
        sent = np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(x, "<u8") for x in right.column("data").to_pylist())])
        counts = np.zeros(len(t.hashes), dtype=np.int64)
        buckets = (t.hashes % np.uint64(n_buckets)).astype(np.int64)
        counts[np.argsort(buckets, kind="stable")] = sent
        c = np.append(counts, ends)
        logs = shared.value.logs(t, counts)
        base = np.log10((c + ADD) / (n + ADD * (v + 1)))[t.of]
        first = t.bounds[:-1]
        columns = [pa.array(t.names, pa.int64()), pa.array(~t.train), pa.array(t.sizes, pa.int64()), pa.array(np.add.reduceat((c > 0)[t.of].astype(np.int64), first)), pa.array([n] * len(t.names), pa.int64()), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(logs, first) / np.log(10))]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    words = counted.where("chunk IS NOT NULL").select("chunk", "bucket", "data")
    return chunks.repartition(tasks, "chunk").groupBy("chunk").cogroup(words.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(one, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
