"""Source divergence audit: how far the words of each source of a language lie from those of the others.

A group is a (lang, source) pair that occurs, a term a maximal run of ASCII letters and characters beyond ASCII, A-Z in lower
case. Each language keeps the terms that occur in at least `min_docs` of its documents. With count occurrences of a term in a group, N
of all kept terms there and V kept terms, p = 1 + floor(10^9 (count + 1) / (N + V)); the distance of p from q is floor((p - q)^2 / q).
Part `pair` gives each other source of the language with the sum over all kept terms, part `term` the kept terms of the
group that lie furthest above the language's own shares.

Count columns are deduplicated: a term is its sparse vector of (source, count), and terms with equal vectors are one column
with a multiplicity. Each pair of sources is evaluated once for each distinct vector: where both counts are above zero, entry by entry;
where one is zero, once for each distinct count of the other; where both are, in one product. Columns are cut into blocks of
bounded size, which meet the sources of their language (at most `SLICE` of them on the left side of a pair) by a cogroup; what is
shuffled back is one sum for each pair and block. Original terms come back only for the vectors that can be among the first.

Counting is done inside the tasks that read the texts, with tables of bounded size, so a frequent term sends one row for each
task and group. A vector has at most as many entries as its language has sources; the result itself has the square of these.

Arithmetic is exact: shares in decimals or by long division in 64 bits (N + V below 9 * 10^15), sums in decimals.

Null texts, langs and sources count as empty ones. Documents are rows: repeated rows count twice, also for `min_docs`. Ids and all
other columns are ignored. Values that are equal are ordered by the item's UTF-8 bytes. Empty tables give no rows; a language without
kept terms gives its pairs with value 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import gather_runs, small_batches, stage

SCALE, MIN_DOCS, TOP = 1_000_000_000, 3, 200
#: Bytes of a text that are cut into terms at once, and terms that a task's table holds before it is sent on.
BLOCK, TABLE = 1 << 20, 1 << 19
#: Entries of vectors in a block (or as many as its language has pairs, so that sums are no more than entries); sources on the left side of the pairs of a task; pairs that are evaluated at once.
ENTRIES, SLICE, PAIRS = 1 << 15, 64, 1 << 20

#: Letters and bytes beyond ASCII stay, A-Z in lower case; all else separates.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, block by block."""
    a = 0
    while a < len(text):
        b = min(a + BLOCK, len(text))
        while b < len(text) and _TERMS[text[b]] != 32:
            b += 1
        yield text[a:b].translate(_TERMS).split()
        a = b


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it); several rows for one term."""
    small_batches(docs.sparkSession)

    def run(batches):
        tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def rows():
            for (lang, source), (n, within) in tables.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array([t.decode("utf-8", "replace") for t in terms], pa.string())]
                    + [pa.array([c[t] for t in terms], pa.int64()) for c in (n, within)],
                    names=["lang", "source", "term", "n", "docs"],
                )
            tables.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, within = tables.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), set()
                for terms in terms_of(text.encode("utf-8", "surrogatepass")):
                    n.update(terms)
                    own.update(terms)
                within.update(own)
                held += len(n) - before
                if held > TABLE:
                    yield from rows()
                    held = 0
        yield from rows()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, vector: the counts of each kept term in the sources that hold it, in their order."""
    counts = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # a term has a row for each source of its language at most
    held = counts.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"), F.sum("docs").alias("docs"))
    return held.where(F.col("docs") >= min_docs).drop("docs")


def columns_of(terms: DataFrame) -> DataFrame:
    """id, lang, vector, times: the distinct vectors and how many terms have each. Ids hold once the table is written."""
    return terms.groupBy("lang", "vector").agg(F.count("*").alias("times")).withColumn("id", F.monotonically_increasing_id())


def group_table(docs: DataFrame, columns: DataFrame) -> DataFrame:
    """lang, source, n (occurrences of kept terms), m (n + V), v (V), and the language's own lang_m and entries."""
    spots = docs.select("lang", "source").distinct()
    each = columns.select("lang", "times", F.explode("vector").alias("e")).select("lang", F.col("e.source").alias("source"), (F.col("e.n") * F.col("times")).alias("n"))
    sums = each.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = columns.groupBy("lang").agg(F.sum("times").alias("v"), F.sum(F.size("vector")).alias("entries"))
    none = F.lit(0).cast("bigint")
    met = spots.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    met = met.select("lang", "source", *(F.coalesce(c, none).alias(c) for c in ("n", "v", "entries")))
    of_lang = Window.partitionBy("lang")  # one row for each source
    return met.withColumn("m", F.col("n") + F.col("v")).withColumn("lang_m", F.sum("n").over(of_lang) + F.col("v"))


# ---------------------------------------------------------------- part `pair`


def shares(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / m) for int64 arrays, digit by digit of base 1000."""
    whole, rest = np.divmod(counts + 1, m)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, m)
        whole = whole * 1000 + digit
    return whole + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def block_sums(sources: np.ndarray, counts: np.ndarray, lengths: np.ndarray, times: np.ndarray, m: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For the sources `left` (rows) and all (columns), the sum over the vectors of what differs from all counts being zero.

    sources, counts: the entries of the vectors, one after another; lengths: entries of each; times: their terms. A pair's
    sum over terms is: both above zero, f(a, b); only one, f(a, 0) or f(0, b); else f(0, 0). Here f(a, 0) - f(0, 0) is taken of
    each distinct count, and the rest of f(a, b) of each pair of entries.
    """
    zero = shares(np.zeros_like(m), m)
    out = np.zeros((len(left), len(m)), dtype=np.int64)
    place = np.full(len(m), -1)
    place[left] = np.arange(len(left))
    base = apart(zero[left][:, None], zero[None, :])
    weights = np.repeat(times, lengths)
    # distinct (source, count), with the terms that have it
    seen, of = np.unique(np.stack([sources, counts]), axis=1, return_inverse=True)
    terms = np.zeros(seen.shape[1], dtype=np.int64)
    np.add.at(terms, of.ravel(), weights)
    p = shares(seen[1], m[seen[0]])
    step = max(1, PAIRS // len(m))
    for a in range(0, len(p), step):
        part = slice(a, a + step)
        g, w = seen[0][part], terms[part]
        on = place[g] >= 0
        np.add.at(out, place[g[on]], w[on, None] * (apart(p[part][on, None], zero[None, :]) - base[place[g[on]]]))
        for rows in (slice(b, b + SLICE) for b in range(0, len(left), SLICE)):  # the same count on the right side
            more = w[:, None] * (apart(zero[left[rows]][None, :], p[part][:, None]) - base[rows][:, g].T)
            np.add.at(out[rows].T, g, more)
    # pairs of entries of one vector
    p = shares(counts, m[sources])
    ends = np.cumsum(lengths)
    vector = np.repeat(np.arange(len(lengths)), lengths)
    own = np.flatnonzero(place[sources] >= 0)
    size = lengths[vector[own]]
    cuts = np.searchsorted(np.cumsum(size), np.arange(PAIRS, int(size.sum()) + PAIRS, PAIRS), "left") + 1 if len(own) else []
    for some in np.split(own, np.unique(np.minimum(cuts, len(own)))) if len(own) else []:
        n = lengths[vector[some]]
        i, j = np.repeat(some, n), gather_runs(ends[vector[some]] - n, n)
        g, h = sources[i], sources[j]
        f = apart(p[i], p[j]) - apart(p[i], zero[h]) - apart(zero[g], p[j]) + base[place[g], h]
        np.add.at(out, (place[g], h), weights[i] * f)
    return out


def pair_sums(columns: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for each ordered pair of different sources of a language."""
    many = F.greatest(F.lit(ENTRIES), F.count("*") * F.count("*"))
    langs = groups.groupBy("lang").agg(F.ceil(F.max("entries") / many).cast("bigint").alias("blocks"), F.ceil(F.count("*") / SLICE).cast("bigint").alias("slices"))
    langs = langs.select("lang", F.greatest("blocks", F.lit(1).cast("bigint")).alias("blocks"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"))
    dealt = columns.join(langs, "lang").select("lang", F.pmod(F.xxhash64("vector"), "blocks").alias("block"), "slice", "vector", "times")
    some = groups.join(langs, "lang").select(F.col("lang").alias("lang"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"), F.col("slice").alias("slice"), *(F.col(c).alias(c) for c in ("source", "m", "v")))

    def evaluate(key: tuple, vectors: pa.Table, sources: pa.Table) -> pa.Table:
        sources = sources.sort_by("source")
        lang, block, part = (k.as_py() for k in key)
        names, m = sources.column("source").combine_chunks(), np.maximum(sources.column("m").to_numpy(), 1)
        left = np.arange(part * SLICE, min((part + 1) * SLICE, len(m)))
        out = np.zeros((len(left), len(m)), dtype=np.int64)
        if vectors.num_rows:
            lists = vectors.column("vector").combine_chunks()
            lengths, flat = np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten()
            at = pa.compute.index_in(flat.field("source"), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
            out += block_sums(at, flat.field("n").to_numpy(zero_copy_only=False), lengths, vectors.column("times").to_numpy(), m, left)
        if block == 0 and len(m) and (v := sources.column("v")[0].as_py()):
            zero = shares(np.zeros_like(m), m)
            out += v * apart(zero[left][:, None], zero[None, :])
        g, h = np.nonzero((left[:, None] != np.arange(len(m))[None, :]) & ((out != 0) | (block == 0)))
        return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "source": names.take(pa.array(left[g])), "item": names.take(pa.array(h)), "value": out[g, h]})

    met = dealt.groupBy("lang", "block", "slice").cogroup(some.groupBy("lang", "block", "slice"))
    sums = met.applyInArrow(evaluate, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(20,0)")).cast("long").alias("value"))


# ---------------------------------------------------------------- part `term`


def share_sql(count: str, m: str) -> str:
    return f"1 + CAST({SCALE} AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(20,0)) div CAST({m} AS DECIMAL(20,0))"


def first_terms(terms: DataFrame, columns: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank of the terms that lie furthest above their language's share."""
    total = F.aggregate("vector", F.lit(0).cast("bigint"), lambda s, e: s + e["n"])
    entries = columns.select("lang", "id", total.alias("total"), F.explode("vector").alias("e")).select("lang", "id", "total", F.col("e.source").alias("source"), F.col("e.n").alias("count"))
    met = entries.join(groups.select("lang", "source", "m", "lang_m"), ["lang", "source"])
    each = met.withColumn("p", F.expr(share_sql("count", "m"))).withColumn("q", F.expr(share_sql("total", "lang_m"))).where("p > q")
    valued = each.select("lang", "source", "id", F.expr("(p - q) * (p - q) div q").alias("value"))
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    # a term among the first `top` has a vector with fewer than `top` vectors above it
    some = valued.withColumn("place", F.rank().over(w)).where(F.col("place") <= top).drop("place")
    named = some.join(columns.select("id", "vector"), "id").join(terms, ["lang", "vector"]).select("lang", "source", F.col("term").alias("item"), "value")
    return named.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    terms = stage(kept_terms(docs, min_docs))
    columns = stage(columns_of(terms))
    groups = stage(group_table(docs, columns))
    pairs = pair_sums(columns, groups)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    out = [df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for part, df in (("pair", pairs), ("term", first_terms(terms, columns, groups, top)))]
    return out[0].unionByName(out[1])
