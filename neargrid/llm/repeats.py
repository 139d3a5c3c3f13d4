"""Removal of repeated passages: bytes covered by a string of `LENGTH` bytes that also starts earlier.

Texts are UTF-8 bytes (null: empty), ordered by doc_id (null first), rows of one doc_id in the order they are stored.

1. Documents are stored in chunks of some megabytes, each one compressed row, which is what later shuffles move. In every
   window of LENGTH bytes the least hash of a run of GRAM bytes is its anchor (winnowing; the leftmost of equal ones).
   The order of hashes is the same everywhere, so equal windows have equal anchors at equal places, and one anchor stands
   for many windows.
2. Each chunk sends its distinct anchor hashes and how many different contexts each has, packed by buckets; a bucket
   returns the hashes that occur twice or more, and marks those with more than `HOT` contexts.
3. A chunk compares its own repeated anchors first (as in 4), and sends those that have a window left with the bytes of
   all their windows. A passage that a third of all documents hold comes once from each chunk.
4. In each bucket, the texts to the right of anchors with one hash, and the reversed texts to their left, are sorted
   deep-shallow. Common prefixes of neighbours give, for every offset of a window, classes of equal windows; all but the
   first of a class are removed. What windows of one anchor remove is one span, as they overlap.
5. A hot anchor (a frequent phrase with different text around it) would be one large group. Its windows go by their own
   hashes instead, and each is sorted among windows with its hash: first within groups of chunks, then what is left of these.
6. Spans return to their chunks, where documents are cut. Every comparison is of bytes; hashes only propose.

Empty texts and those shorter than LENGTH keep all bytes. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RunHashes, gather_runs, ragged, small_batches, stage, task_count
from .deep_shallow import deep_shallow

LENGTH = 100
GRAM = 20
#: Starts of runs in a window, and so the most places of a window relative to its anchor.
WINDOW = LENGTH - GRAM + 1
LEFT, RIGHT = 80, 104  # bytes kept on both sides of an anchor, rounded up to words
#: Text whose anchors are compared together.
BUCKET_BYTES = 4 << 20
#: Items of one anchor that are compared as one group (some 7 MB).
HOT = 1 << 15
#: Groups of chunks that hot windows are compared in first.
SALTS = 64

PACKED = "chunk long, n_bytes long, data binary"
LEVEL = 6
CHUNK_BYTES = 4 << 20
#: Starts of windows that are looked at together; places among them have 19 bits, the hashes' order the other 45.
STEP = 1 << 18
PLACE_BITS = 19
ITEM = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("chunk", "<i8"), ("nth", "<i4"), ("at", "<i8"), ("low", "i1"), ("high", "i1"), ("bytes", "u1", (LEFT + RIGHT,))])
WINDOWS = np.dtype([("hash", "<u8"), ("doc", "<i8"), ("chunk", "<i8"), ("nth", "<i4"), ("at", "<i8"), ("bytes", "u1", (RIGHT,))])
SEEN = np.dtype([("hash", "<u8"), ("n", "<u2")])
WANTED = np.dtype([("hash", "<u8"), ("hot", "u1")])
NO_ID = -(1 << 63)


def packed_chunks(docs: DataFrame) -> DataFrame:
    """One row for each chunk: its documents (doc_id, text) as one compressed Arrow stream.

    Done where documents are read, by one worker a core: another one behind it would hold memory of its own.
    """
    small_batches(docs.sparkSession, size=CHUNK_BYTES)

    def run(batches):
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            own = pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema) as out:
                out.write_batch(own)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sum(map(len, texts))], pa.int64()), pa.array([squeeze(sink.getvalue())], pa.binary())], names=["chunk", "n_bytes", "data"])
            chunk += 1

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PACKED)


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(data)).read_all()


class Anchors:
    """Anchors of the texts of a chunk: places in the joined bytes, hashes, and the windows each stands for."""

    def __init__(self, texts: list[bytes]):
        self.raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.bounds = ragged([len(x) for x in texts])
        found = [self._block(a) for a in range(0, max(0, len(self.raw) - LENGTH + 1), STEP)]
        empty = np.zeros(0, dtype=np.int64)
        self.at, self.low, self.high, self.doc = (np.concatenate([empty, *(f[k] for f in found)]) for k in range(4))
        self.hashes = np.concatenate([empty.view(np.uint64), *(f[4] for f in found)])
        # an anchor whose windows lie in two blocks is one
        new = np.append(True, self.at[1:] != self.at[:-1])[: len(self.at)]
        first = np.flatnonzero(new)
        if len(first) < len(new):
            self.high = self.high[np.append(first[1:], len(new)) - 1]
            self.at, self.low, self.doc, self.hashes = self.at[first], self.low[first], self.doc[first], self.hashes[first]

    def _block(self, a: int) -> tuple[np.ndarray, ...]:
        part = self.raw[a : a + STEP + LENGTH - 1]
        starts = np.arange(len(part) - GRAM + 1)
        hashes = RunHashes(part).of(starts, starts + GRAM)
        least = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | starts.astype(np.uint64)
        span = 1
        while span < WINDOW:
            step = min(span, WINDOW - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        low, high = np.searchsorted(self.bounds, [a, a + len(least) - 1], side="right") - 1
        edges = np.clip(self.bounds[low : high + 2] - a, 0, len(least))
        doc = np.repeat(np.arange(low, high + 1), np.diff(edges))
        windows = np.flatnonzero(np.arange(len(least)) + (a + LENGTH) <= self.bounds[doc + 1])
        at = (least[windows] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
        last = np.append(first[1:], len(at)) - 1 if len(at) else first
        return at[first] + a, windows[first] - at[first], windows[last] - at[first], doc[windows[first]], hashes[at[first]]

    def contexts(self) -> np.ndarray:
        """Distinct anchor hashes, and how many different contexts each has here (SEEN rows)."""
        n = self.high + LENGTH - self.low
        whole = RunHashes(self.raw).of(self.at + self.low, self.at + self.low + n)
        key = np.unique(np.stack([self.hashes, whole ^ self.low.astype(np.uint64)], axis=1), axis=0)[:, 0] if len(n) else self.hashes
        own, first, counts = np.unique(self.hashes, return_index=True, return_counts=True)
        out = np.zeros(len(own), dtype=SEEN)
        # equal contexts count as two at most, as they will be compared here first
        different = np.diff(np.append(np.searchsorted(key, own), len(key)))
        out["hash"], out["n"] = own, np.minimum(np.maximum(different, np.minimum(counts, 2)), 65535)
        return out

    def items(self, which: np.ndarray, names: np.ndarray, chunk: int) -> np.ndarray:
        """What is compared of these anchors. Bytes that belong to none of their windows are 0."""
        out = np.zeros(len(which), dtype=ITEM)
        at, low, high = self.at[which], self.low[which], self.high[which]
        out["hash"], out["low"], out["high"], out["chunk"] = self.hashes[which], low, high, chunk
        out["doc"], out["nth"], out["at"] = names[self.doc[which]], self.doc[which], at - self.bounds[self.doc[which]]
        lengths = high + LENGTH - low
        place = np.arange(len(which)) * (LEFT + RIGHT) + LEFT + low
        flat = np.zeros(len(which) * (LEFT + RIGHT), dtype=np.uint8)
        flat[gather_runs(place, lengths)] = self.raw[gather_runs(at + low, lengths)]
        out["bytes"] = flat.reshape(-1, LEFT + RIGHT)
        return out


def ranks(items: np.ndarray) -> np.ndarray:
    """The place of each item in the order of documents."""
    out = np.empty(len(items), dtype=np.int64)
    out[np.lexsort((items["at"], items["nth"], items["chunk"], items["doc"]))] = np.arange(len(items))
    return out


def repeats(key: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether an item with the same key comes earlier."""
    order = np.lexsort((rank, key))
    out = np.zeros(len(key), dtype=bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out


def lost_windows(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the items of whole hash groups, the windows that also start earlier: item and offset from its anchor."""
    n = len(items)
    rank = ranks(items)
    _, group = np.unique(items["hash"], return_inverse=True)
    right, right_lcp = deep_shallow(items["bytes"][:, LEFT:], group)
    left, left_lcp = deep_shallow(items["bytes"][:, :LEFT][:, ::-1], group)
    low, high = items["low"].astype(np.int64), items["high"].astype(np.int64)
    class_r, class_l = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    gone, offsets = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for offset in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        on = np.flatnonzero((low <= offset) & (offset <= high))
        if len(on) < 2:
            continue
        class_r[right] = np.cumsum(right_lcp < LENGTH + offset)
        class_l[left] = np.cumsum(left_lcp < -offset)
        lost = on[repeats(class_r[on] * (n + 1) + class_l[on], rank[on])]
        gone.append(lost)
        offsets.append(np.full(len(lost), offset))
    return np.concatenate(gone), np.concatenate(offsets)


def spans_of(items: np.ndarray, gone: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows (chunk, nth, start, end): one for each item that has lost windows, which overlap each other."""
    least, most = np.full(len(items), 127, dtype=np.int64), np.full(len(items), -128, dtype=np.int64)
    np.minimum.at(least, gone, offsets)
    np.maximum.at(most, gone, offsets)
    out = np.flatnonzero(most >= least)
    own = items[out]
    return np.stack([own["chunk"], own["nth"], own["at"] + least[out], own["at"] + most[out] + LENGTH], axis=1).astype("<i8")


def windows_of(items: np.ndarray, gone: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """All windows of the items but for those that are lost, as rows of their own."""
    low, high = items["low"].astype(np.int64), items["high"].astype(np.int64)
    n = high - low + 1
    of, offset = np.repeat(np.arange(len(items)), n), gather_runs(low, n)
    lost = np.zeros(len(items) * 256, dtype=bool)
    lost[gone * 256 + offsets + 128] = True
    keep = ~lost[of * 256 + offset + 128]
    of, offset = of[keep], offset[keep]
    out = np.zeros(len(of), dtype=WINDOWS)
    for name in ("doc", "chunk", "nth"):
        out[name] = items[name][of]
    out["at"] = items["at"][of] + offset
    flat = np.ascontiguousarray(items["bytes"]).ravel()
    out["bytes"][:, :LENGTH] = flat[(of * (LEFT + RIGHT) + LEFT + offset)[:, None] + np.arange(LENGTH)]
    starts = np.arange(len(of)) * LENGTH
    out["hash"] = RunHashes(np.ascontiguousarray(out["bytes"][:, :LENGTH]).ravel()).of(starts, starts + LENGTH)
    return out


def _packed(buckets: np.ndarray, values: np.ndarray, chunk: int, squeeze=bytes) -> pa.RecordBatch:
    """Values in one binary row for each bucket that has any."""
    order = np.argsort(buckets, kind="stable")
    sorted_ = buckets[order]
    cut = np.append(np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])[: len(sorted_)]), len(sorted_))
    rows = [squeeze(values[order[a:b]].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(sorted_[cut[:-1]], pa.int64()), pa.array([chunk] * len(rows), pa.int64()), pa.array(rows, pa.binary())], names=["bucket", "chunk", "data"])


def _together(frames: DataFrame, f, schema: str, tasks: int) -> DataFrame:
    """f over the rows (chunk, data) of each bucket; memory holds one bucket."""
    sorted_ = frames.repartition(tasks, "bucket").sortWithinPartitions("bucket")

    def run(batches):
        now, held = None, []
        for batch in batches:
            for bucket, chunk, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and held:
                    yield from f(held)
                    held = []
                now = bucket
                held.append((chunk, data))
        if held:
            yield from f(held)

    return sorted_.mapInArrow(run, schema)


def _spans(rows: np.ndarray) -> pa.RecordBatch:
    """Spans (chunk, nth, start, end) packed by chunk."""
    packed = _packed(rows[:, 0], rows[:, 1:], 0)
    return pa.RecordBatch.from_arrays([packed.column(0), packed.column(2)], names=["chunk", "spans"])


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(data)


def _read(held: list, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(zstandard.decompress(d), kind) for _, d in held])


SENT = "kind int, bucket long, chunk long, data binary"


def _rows(kind: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of SENT. kind 0: spans of a chunk, 1: items, 2: windows."""
    n = batch.num_rows
    columns = [pa.nulls(n, pa.int64()), batch.column(0), batch.column(1)] if kind == 0 else batch.columns
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), *columns], names=["kind", "bucket", "chunk", "data"])


def find_spans(chunks: DataFrame, hot: int = HOT, salts: int = SALTS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(chunk, spans) for all that is to be removed, in any number of rows a chunk."""
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    tasks = task_count(chunks.sparkSession, total)
    n = np.uint64(max(tasks, -(-total // bucket_bytes)))

    def texts_of(data: bytes):
        table = unpacked(data)
        return table, Anchors(table.column("text").to_pylist())

    def hashes(batches):
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data"), strict=True):
                seen = texts_of(data.as_py())[1].contexts()
                yield _packed((seen["hash"] % n).astype(np.int64), seen, chunk)

    def repeated(held):
        rows = np.concatenate([np.frombuffer(d, SEEN) for _, d in held])
        of = np.repeat([c for c, _ in held], [len(d) // SEEN.itemsize for _, d in held])
        _, which = np.unique(rows["hash"], return_inverse=True)
        times = np.bincount(which, weights=rows["n"])[which]
        keep = times > 1
        out = np.zeros(int(keep.sum()), dtype=WANTED)
        out["hash"], out["hot"] = rows["hash"][keep], times[keep] > hot
        packed = _packed(of[keep], out, 0)
        yield pa.RecordBatch.from_arrays([packed.column(0), packed.column(2)], names=["chunk", "hashes"])

    def send(key, left: pa.Table, right: pa.Table) -> pa.Table:
        chunk = key[0].as_py()
        table, anchors = texts_of(left.column("data")[0].as_py())
        wanted = np.concatenate([np.zeros(0, WANTED), *(np.frombuffer(x, WANTED) for x in right.column("hashes").to_pylist())])
        wanted = wanted[np.argsort(wanted["hash"])]
        names = np.array([NO_ID if x is None else x for x in table.column("doc_id").to_pylist()], dtype=np.int64)
        own = anchors.items(np.flatnonzero(np.isin(anchors.hashes, wanted["hash"])), names, chunk)
        own = own[np.argsort(own["hash"], kind="stable")]
        # anchors that occur twice here are compared first; those that lose all their windows need not be sent
        same = own["hash"][1:] == own["hash"][:-1]
        twice = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(own) else np.zeros(0, dtype=np.int64)
        gone, offsets = lost_windows(own[twice])
        gone = twice[gone]
        out = [_rows(0, _spans(spans_of(own, gone, offsets)))]
        whole = np.bincount(gone, minlength=len(own)) > own["high"].astype(np.int64) - own["low"]
        is_hot = wanted["hot"][np.searchsorted(wanted["hash"], own["hash"])] > 0 if len(own) else whole
        plain = own[~whole & ~is_hot]
        out.append(_rows(1, _packed((plain["hash"] % n).astype(np.int64), plain, chunk, _squeeze)))
        if is_hot.any():
            place = np.cumsum(is_hot) - 1
            lost = is_hot[gone]
            rest = windows_of(own[is_hot], place[gone[lost]], offsets[lost])
            out.append(_rows(2, _packed((rest["hash"] % n).astype(np.int64), rest, chunk, _squeeze)))
        return pa.Table.from_batches(out)

    def compare(held):
        items = _read(held, ITEM)
        yield _spans(spans_of(items, *lost_windows(items)))

    def compare_windows(last: bool):
        def run(held):
            rows = _read(held, WINDOWS)
            _, group = np.unique(rows["hash"], return_inverse=True)
            order, shared = deep_shallow(rows["bytes"], group)
            key = np.empty(len(rows), dtype=np.int64)
            key[order] = np.cumsum(shared < LENGTH)
            again = repeats(key, ranks(rows))
            gone = rows[again]
            yield _rows(0, _spans(np.stack([gone["chunk"], gone["nth"], gone["at"], gone["at"] + LENGTH], axis=1).astype("<i8")))
            if not last:
                rest = rows[~again]
                yield _rows(2, _packed((rest["hash"] % n).astype(np.int64), rest, 0, _squeeze))

        return run

    sent = _together(chunks.mapInArrow(hashes, "bucket long, chunk long, data binary"), repeated, "chunk long, hashes binary", tasks)
    first = stage(chunks.repartition(tasks, "chunk").groupBy("chunk").cogroup(sent.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(send, SENT))
    spans = _together(first.where("kind = 1").select("bucket", "chunk", "data"), compare, "chunk long, spans binary", tasks)
    spans = spans.unionByName(first.where("kind = 0").select("chunk", F.col("data").alias("spans")))
    hot_windows = first.where("kind = 2")
    if hot_windows.isEmpty():
        return spans
    salted = hot_windows.select(F.expr(f"bucket * {salts} + pmod(xxhash64(chunk), {salts})").alias("bucket"), "chunk", "data")
    second = stage(_together(salted, compare_windows(False), SENT, tasks))
    third = _together(second.where("kind = 2").select("bucket", "chunk", "data"), compare_windows(True), SENT, tasks)
    for part in (second, third):
        spans = spans.unionByName(part.where("kind = 0").select("chunk", F.col("data").alias("spans")))
    return spans


def union(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, end) rows; runs that touch are one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.append(True, spans[1:, 0] > reach[:-1])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


def remove_repeats(docs: DataFrame, texts: bool = False, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, what is left of each text (binary)."""
    chunks = stage(packed_chunks(docs), codec="uncompressed")
    spans = find_spans(chunks, **options)
    kept = "kept" if texts else "kept_sha256"

    def cut(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left = unpacked(left.column("data")[0].as_py())
        rows = np.concatenate([np.zeros((0, 3), "<i8"), *(np.frombuffer(x, "<i8").reshape(-1, 3) for x in right.column("spans").to_pylist())])
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        at = np.searchsorted(rows[:, 0], np.arange(left.num_rows + 1))
        sizes, removed, runs, out = [], [], [], []
        for i, text in enumerate(left.column("text").to_pylist()):
            own = rows[at[i] : at[i + 1], 1:]
            if len(own):
                own = union(own)
                edges = [0, *own.ravel().tolist(), len(text)]
                rest = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            else:
                rest = text
            sizes.append(len(text))
            removed.append(len(text) - len(rest))
            runs.append(len(own))
            out.append(rest if texts else hashlib.sha256(rest).hexdigest())
        columns = [left.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(out, pa.binary() if texts else pa.string())]
        return pa.Table.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", kept])

    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, {kept} {'binary' if texts else 'string'}"
    tasks = task_count(docs.sparkSession, chunks.agg(F.sum("n_bytes")).first()[0] or 0)
    return chunks.repartition(tasks, "chunk").groupBy("chunk").cogroup(spans.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(cut, schema)
