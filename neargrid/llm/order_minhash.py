"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is its sequence of runs of five words (shingles; a shorter text is one shingle), each labelled with the
number of times it occurred before. For each of `tables` hash functions, the `sample` labelled shingles with the least
hashes are kept in text order; documents that agree on them are candidates. Two documents are alike if an alignment that
keeps the order of both finds enough common shingles m: m / (n1 + n2 - m) >= 0.8. So n1 + n2 - 2m <= (n1 + n2) / 9
insertions and deletions are allowed, which bounds the band that has to be searched.

1. Documents with equal words form one class at once; a class is represented by its least doc_id.
2. All bucket entries are sorted by key and by how the series of least hashes goes on, over ranges, so that a large
   bucket spreads over tasks. Each entry is compared with its `NEAR` next ones of the same key: within a large group that
   is a few comparisons a member, with those that share most, and in every table with others. No group is gathered.
3. Matches are joined into classes by large and small stars (Kiveris et al. 2014).
4. Each bucket keeps one entry for each class, and steps 2 and 3 are repeated over what is left, until no match is new:
   members that were apart from each other in the order become neighbours. These rounds join most of a large group with
   a few comparisons a member.
5. What they leave is compared in full: in each bucket that still holds more than one class, every two texts of different
   classes, with all members of each class. Large buckets are dealt into blocks, and each two blocks are one group of rows:
   common shingles are counted by matrix products, and only pairs that have enough of them are aligned. Two blocks of one
   class are left out. So the classes are those of all pairs that share a bucket.

Null counts as empty; all texts without words are one class. Rows with one doc_id are compared with all texts of that id,
and each row gets the class of its own words' least doc_id; a null doc_id is left out, as it names no document. Empty tables
give no rows. Joins on a digest or a bucket key are plain joins of narrow rows, whose large keys adaptive execution splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mix64, small_batches, stage
from .words import Words, window_hashes

WORDS = 5
SIMILARITY = 0.8
TABLES = 12
SAMPLE = 3
#: Following entries of a bucket with which each is compared in a round.
NEAR = 3
#: Texts, and characters, of a block of a bucket that is compared in full.
BLOCK = 256
BLOCK_CHARS = 2 << 20
#: Tasks that the rows of one bucket go to where they are only picked out.
SALTS = 16
#: Columns of one matrix product of common shingles.
COLUMNS = 4096


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five words; a shorter text is one run."""
    return window_hashes(words, min(WORDS, len(words))) if len(words) else words


def labelled(x: np.ndarray) -> np.ndarray:
    """Each hash mixed with the number of equal ones before it."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(x) else np.zeros(0, dtype=bool)
    at = np.arange(len(x))
    nth = np.empty(len(x), dtype=np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0)) if len(x) else at
    return x if not nth.any() else mix64(x ^ mix64(nth, 7))


def sketch(words: np.ndarray, tables: int = TABLES, sample: int = SAMPLE) -> np.ndarray:
    """For each table three numbers: the key, made of the least labelled shingles in text order, and two that say how
    the series of least hashes goes on. Sorted by all three, texts that share more of the series lie closer."""
    x = labelled(shingles(words))
    if not len(x):
        return np.zeros((0, 3), dtype=np.int64)
    seeds = mix64(np.arange(tables, dtype=np.uint64), 11)
    with np.errstate(over="ignore"):
        h = (x[None, :] ^ seeds[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
    k = min(sample + 4, len(x))
    at = np.argpartition(h, k - 1, axis=1)[:, :k] if k < len(x) else np.broadcast_to(np.arange(k), (tables, k))
    order = np.argsort(np.take_along_axis(h, at, axis=1), axis=1)
    at = np.take_along_axis(at, order, axis=1)
    key = seeds.copy()
    for part in x[np.sort(at[:, :sample], axis=1)].T:
        key = mix64(key ^ part, 13)
    out = np.zeros((tables, 3), dtype=np.uint64)
    out[:, 0] = key
    for j in range(sample, k):
        out[:, 1 + (j - sample) // 2] = mix64(out[:, 1 + (j - sample) // 2] ^ x[at[:, j]], 17)
    return out.view(np.int64)


def alignment(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Insertions and deletions that turn a into b, or most + 1 if there are more.

    Only diagonals within the band of `most` are searched. furthest[k] is how far one comes on diagonal k with the steps
    so far; equal runs are passed at once, all diagonals together, by comparing hashes of runs of doubling lengths.
    """
    lead = 0
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    lead = int(differ[0]) if len(differ) else n
    a, b = a[lead:], b[lead:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])
    tail = n - 1 - int(differ[-1]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    n, m = len(a), len(b)
    if not n or not m:
        return min(n + m, most + 1)
    if abs(n - m) > most:
        return most + 1
    _, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = codes[:n], codes[n:]
    levels = [(a, b)]  # numbers of equal runs of 1, 2, 4, ... elements
    while (w := 1 << len(levels)) <= min(n, m):
        half = w >> 1
        pa_, pb = levels[-1]
        big = np.int64(max(pa_.max(), pb.max()) + 1)
        both = np.concatenate([pa_[:-half] * big + pa_[half:], pb[:-half] * big + pb[half:]])
        _, codes = np.unique(both, return_inverse=True)
        levels.append((codes[: len(pa_) - half], codes[len(pa_) - half :]))

    def slide(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        for bit in range(len(levels) - 1, -1, -1):
            la, lb = levels[bit]
            for _ in range(2 if bit == len(levels) - 1 else 1):
                y = x - k
                ok = (x < len(la)) & (y < len(lb)) & (y >= 0)
                ok[ok] = la[x[ok]] == lb[y[ok]]
                x = x + (ok.astype(np.int64) << bit)
        return x

    furthest = slide(np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))
    if n == m and furthest[0] >= n:
        return 0
    for d in range(1, most + 1):
        k = np.arange(-d, d + 1, 2)
        down = np.concatenate([[-1], furthest])  # from diagonal k - 1, delete from a
        right = np.concatenate([furthest, [-1]])  # from diagonal k + 1, insert from b
        x = np.maximum(np.where(down >= 0, down + 1, -1), right)
        x = np.minimum(x, np.minimum(n, m + k))
        live = (x >= 0) & (x - k >= 0)
        x = np.where(live, slide(np.maximum(x, 0), k), -1)
        if ((x >= n) & (x - k >= m)).any():
            return d
        furthest = x
    return most + 1


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements, each as often as both have it: no alignment finds more."""
    both = np.concatenate([labelled(a), labelled(b)])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sequences of shingles share enough of them in order."""
    n = len(a) + len(b)
    if not n or len(a) == len(b) and np.array_equal(a, b):
        return True
    most = int(n * (1 - similarity) / (1 + similarity) + 1e-9)
    return n - 2 * overlap(a, b) <= most and alignment(a, b, most) <= most


def shared_shingles(rows: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of common elements of each row of `left` and each of `right`; rows hold no element twice."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    _, code, n = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    at = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    column = np.cumsum(n > 1) - 1
    at, code = at[n[code] > 1], column[code[n[code] > 1]]
    order = np.argsort(code, kind="stable")
    at, code = at[order], code[order]
    edges = np.arange(0, (int(code[-1]) if len(code) else -1) + COLUMNS + 1, COLUMNS)
    cut = np.searchsorted(code, edges)
    for first, a, b in zip(edges[:-1], cut[:-1], cut[1:], strict=True):
        x = np.zeros((len(rows), COLUMNS), dtype=np.float32)
        x[at[a:b], code[a:b] - first] = 1
        out += x[left] @ x[right].T
    return out


def links_between(texts: list[np.ndarray], names: list[int], left: np.ndarray, right: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Pairs of alike texts (one of left, one of right) that join all classes with alike members. names: their classes."""
    common = shared_shingles([labelled(x) for x in texts], left, right)
    sizes, names = np.array([len(x) for x in texts]), np.array(names)
    total = sizes[left][:, None] + sizes[right][None, :]
    most = (total * (1 - similarity) / (1 + similarity) + 1e-9).astype(np.int64)
    maybe = (total - 2 * common <= most) & (names[left][:, None] != names[right][None, :])
    top = {x: x for x in names.tolist()}

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for i, j in np.argwhere(maybe).tolist():
        a, b = int(left[i]), int(right[j])
        x, y = find(int(names[a])), find(int(names[b]))
        if x != y and alignment(texts[a], texts[b], int(most[i, j])) <= most[i, j]:
            top[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


# ---------------------------------------------------------------- Spark

SKETCH = "doc_id long, digest binary, keys array<long>"


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, a digest of all words, and the bucket entries, three numbers for each table."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            words = Words(batch.column(1))
            digests, keys = [], []
            for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
                digests.append(xxhash.xxh3_128_digest(words.hashes[a:b].tobytes()))
                keys.append(sketch(words.hashes[a:b]).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "keys"])

    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SKETCH)


def neighbours(entries: DataFrame, near: int = NEAR) -> DataFrame:
    """Pairs (a, b) of different nodes that lie within `near` places of each other in one bucket.

    entries: key, next1, next2, node. They are sorted over ranges. What lies across the border of two ranges is found
    from the first and last rows of each range, which are `2 * near` rows a task.
    """
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "next1", "next2", "node"]

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held, heads, tail, total = [], [], [], 0
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            if total < near:
                heads += rows[: near - total]
            total += len(rows)
            rows = tail + rows
            fresh = len(tail)
            pairs = set()
            for i in range(max(1, fresh), len(rows)):
                key, node = rows[i]
                for j in range(max(0, i - near), i):
                    if rows[j][0] == key and rows[j][1] != node:
                        pairs.add((min(node, rows[j][1]), max(node, rows[j][1])))
            tail = rows[-near:]
            a, b = zip(*pairs, strict=True) if pairs else ([], [])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["at", "key", "a", "b"])
        held = [(task * 4 * near + i, *r, None) for i, r in enumerate(heads)] + [(task * 4 * near + 2 * near + i, *r, None) for i, r in enumerate(tail)]
        columns = list(zip(*held, strict=True)) if held else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["at", "key", "a", "b"])

    ranged = entries.repartitionByRange(n, *order).sortWithinPartitions(*order).select("key", "node")
    both = stage(ranged.mapInArrow(run, "at long, key long, a long, b long"))
    edge = both.where("at IS NOT NULL").select("at", "key", F.col("a").alias("node"))
    w = Window.orderBy("at")
    across = None
    for k in range(1, 2 * near + 1):
        part = edge.select("node", "key", F.lead("node", k).over(w).alias("other"), F.lead("key", k).over(w).alias("key2"))
        part = part.where("key = key2 AND node <> other").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
        across = part if across is None else across.unionByName(part)
    return both.where("at IS NULL").select("a", "b").unionByName(across).distinct()


def verify(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts are alike. texts: node, text."""

    def run(batches):
        for batch in batches:
            first, second = Words(batch.column(2)), Words(batch.column(3))
            ok = []
            for i in range(batch.num_rows):
                x = shingles(first.hashes[first.bounds[i] : first.bounds[i + 1]])
                y = shingles(second.hashes[second.bounds[i] : second.bounds[i + 1]])
                ok.append(alike(x, y, similarity))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(run, "a long, b long")


def classes(edges: DataFrame) -> DataFrame:
    """node and its class (the least node joined with it), for all nodes of the edges (a, b).

    A large and a small star are one job; a second one says by count and hashes whether they have changed anything.
    """
    now, before = edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 32))).first()
        if state == before:
            break
        before = state
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("class"))
    return stage(stars.unionByName(stars.select(F.col("class").alias("node"), "class").distinct()))


def compare_fully(entries: DataFrame, labels: DataFrame | None, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Matches (a, b) that join all classes which share a bucket and have alike members.

    Buckets of up to NEAR + 1 entries have been compared in full by `neighbours`. A class that fills more than a block has
    blocks of its own; the others of its bucket are pooled. Nothing is numbered by a window: nodes are dealt by hash.
    """
    named = entries.select("key", "node")
    named = named.withColumn("class", F.col("node")) if labels is None else named.join(labels, "node", "left").select("key", "node", F.coalesce("class", "node").alias("class"))
    several = named.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("x"), F.max("class").alias("y")).where(f"n > {NEAR + 1} AND x <> y").select("key")
    # narrow rows of one key are dealt over SALTS tasks
    several = several.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    named = named.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).join(several, ["key", "salt"], "left_semi").drop("salt")
    rest = stage(named.join(texts.select("node", F.length("text").alias("chars")), "node"))
    own = rest.groupBy("key", "class").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    own = stage(own.withColumn("home", F.expr(f"CASE WHEN n > {BLOCK} OR chars > {BLOCK_CHARS} THEN class END")))
    blocks = own.groupBy("key", "home").agg(F.expr(f"greatest(ceil(sum(n) / {BLOCK}), ceil(sum(chars) / {BLOCK_CHARS}), 1)").alias("parts"))
    blocks = stage(blocks)
    placed = rest.join(own.select("key", "class", "home"), ["key", "class"]).alias("m").join(blocks.alias("b"), F.expr("m.key = b.key AND m.home <=> b.home"))
    placed = placed.select(F.expr("struct(m.key, m.home, pmod(xxhash64(m.node), b.parts) AS part)").alias("block"), "m.node", "m.class")
    placed = placed.join(texts, "node").select("block", "node", "class", "text")
    each = blocks.select("key", "home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select("key", F.struct("key", "home", "part").alias("block"))
    both = each.select("key", F.col("block").alias("i")).join(each.select("key", F.col("block").alias("j")), "key").where("i <= j AND NOT (i.home IS NOT NULL AND i.home <=> j.home)").select("i", "j")
    sides = both.select("i", "j", F.col("i").alias("block"), F.lit(0).alias("side")).unionByName(both.where("i < j").select("i", "j", F.col("j").alias("block"), F.lit(1).alias("side")))
    groups = sides.join(placed, "block").select(F.to_json("i").alias("i"), F.to_json("j").alias("j"), "side", "node", "class", "text")

    def run(table: pa.Table) -> pa.Table:
        side, nodes = table.column("side").to_numpy(), table.column("node").to_pylist()
        words = Words(table.column("text").combine_chunks())
        own = [shingles(words.hashes[a:b]) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if table.column("i")[0] != table.column("j")[0] else left
        found = [sorted((nodes[x], nodes[y])) for x, y in links_between(own, table.column("class").to_pylist(), left, right, similarity)]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return groups.groupBy("i", "j").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id (the least doc_id of its class) for every document with an id."""
    rows = stage(sketches(docs))
    reps = stage(rows.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")))
    triples = F.expr("explode(transform(sequence(0, size(keys) - 3, 3), i -> struct(keys[i] AS key, keys[i + 1] AS next1, keys[i + 2] AS next2)))")
    entries = reps.where(F.size("keys") > 0).select("node", triples.alias("t")).select("t.key", "t.next1", "t.next2", "node")
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    entries = stage(entries.join(shared, "key", "left_semi"))
    nodes = entries.select("node").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node", "left_semi")
    texts = stage(texts.dropDuplicates(["node", "text"]))
    links, labels, tried = None, None, None
    while True:
        left = entries
        if labels is not None:  # one entry of each class stays in a bucket
            named = entries.join(labels, "node", "left").withColumn("class", F.coalesce("class", "node"))
            left = named.groupBy("key", "class").agg(F.min(F.struct("next1", "next2", "node")).alias("s")).select("key", "s.next1", "s.next2", "s.node")
        pairs = neighbours(left)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stage(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = stage(verify(pairs, texts, similarity))
        if new.isEmpty():
            break
        links = new if links is None else links.unionByName(new)
        labels = classes(links)
    more = stage(compare_fully(entries, labels, texts, similarity))
    if not more.isEmpty():
        labels = classes(more if links is None else links.unionByName(more))
    out = rows.select("doc_id", "digest").join(reps.select("digest", "node"), "digest").select("doc_id", "node")
    if labels is None:
        return out.select("doc_id", F.col("node").alias("class_id"))
    return out.join(labels, "node", "left").select("doc_id", F.coalesce("class", "node").alias("class_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The document with the least doc_id of each class, and all documents without an id."""
    kept = near_duplicates(docs, **options).where("doc_id = class_id").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
