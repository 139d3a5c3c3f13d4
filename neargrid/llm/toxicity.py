"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

The examples are a sample of the labelled documents that the caller allows for training: the `per_class` doc_ids of each
label with the least hash; of rows with one doc_id the least text, and a doc_id with both labels is toxic. Terms are all
words of a text and the first four bytes of longer words. A term's weight in a text is (1 + ln count) * idf, and
a text's norm goes over all its terms. idf is ln((1 + N) / (1 + df)) + 1; df is counted over all documents for each term
of an example, and a term that no example holds has a df of 0: it adds to the norm and meets nothing.

Each term has a posting list, cut by blocks of similar examples, and for each block its largest weight. A query adds
these maxima up, opens the blocks with the largest sums, then all others whose sum reaches the k-th cosine found: the result
is exact. An example with the query's own text is left out, so no row's label feeds its own score, and equal texts
have equal scores; ties go to the lesser digest of the text.

The k nearest by that cosine vote, each with the square of its nearness in the terms that tell the labels apart: the cosine of the
same vectors with every term times z, which says how far the shares of the labels' examples with the term lie apart, in
standard deviations. Votes are weighted back to the labels' shares among all training rows and stand beside a constant vote
for the overall share; isotonic regression over the examples' own votes calibrates them. A text without a term of an example
gets the calibrated overall share.

Null and empty texts have no terms. Rows with one doc_id twice give two scores. A null doc_id gets a score and is not held
out. Without training rows every score is 0, with one label only it is that label. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, gather_runs, ragged, small_batches, stage
from .words import Words

#: Examples of each label at most: the bound of the sample that the classifier is fitted on.
PER_CLASS = 1000
PREFIXES = (4,)
NEAREST = 15
THRESHOLD = 0.3
BLOCK = 64
#: Blocks that are opened first.
FIRST = 4
#: Results that a task keeps for texts that come again.
KNOWN = 4096
#: Weight of the vote for the overall share.
PRIOR = 1.0


def counted(texts, vocabulary: np.ndarray | None = None, rest: bool = False) -> tuple[np.ndarray, ...]:
    """For each text, as offsets, its distinct terms with their counts; the terms' names (places in a sorted vocabulary;
    without one, in the fourth result). With `rest`, a fifth: for each text the sum of squares of 1 + ln count over its
    terms outside the vocabulary."""
    words = Words(texts, PREFIXES)
    text = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    # a short word is its own prefix; it counts once
    columns = [words.hashes, *(c for c in words.prefixes.T)]
    on = [np.ones(len(text), dtype=bool), *(c != words.hashes for c in columns[1:])]
    if vocabulary is None:
        vocabulary = np.unique(np.concatenate([c[k] for c, k in zip(columns, on, strict=True)]))
    codes, n, beyond = [], max(1, len(vocabulary)), []
    for c, k in zip(columns, on, strict=True):
        c, of = c[k], text[k]
        place = np.minimum(np.searchsorted(vocabulary, c), n - 1)
        hit = vocabulary[place] == c if len(vocabulary) else np.zeros(len(c), dtype=bool)
        codes.append(of[hit] * n + place[hit])
        beyond.append((of[~hit], c[~hit]))
    codes, counts = np.unique(np.concatenate(codes), return_counts=True)
    out = np.searchsorted(codes, np.arange(len(words.bounds)) * n), codes % n, counts, vocabulary
    if not rest:
        return out
    of, name = (np.concatenate(x) for x in zip(*beyond, strict=True))
    by = np.lexsort((name, of))
    of, name = of[by], name[by]
    at = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (name[1:] != name[:-1]))) if len(of) else np.zeros(0, dtype=np.int64)
    times = np.diff(np.append(at, len(of)))
    return *out, np.bincount(of[at], weights=(1 + np.log(times)) ** 2, minlength=len(words.bounds) - 1)


@dataclass
class BlockMaxIndex:
    """Examples in blocks of similar ones. Postings are sorted by term, block and example; an entry is the part of a
    posting list that lies in one block."""

    digests: list[bytes]
    toxic: np.ndarray
    weight: np.ndarray
    rank: np.ndarray  # of the digests
    first: np.ndarray  # of each term, its first entry
    block: np.ndarray  # of each entry
    top: np.ndarray  # of each entry, the largest weight
    at: np.ndarray  # of each entry, its first posting
    example: np.ndarray
    share: np.ndarray
    own: np.ndarray  # of each example, its first term
    term: np.ndarray
    told: np.ndarray  # the terms' shares times z, with a norm of 1 for each example

    @classmethod
    def build(cls, digests: list[bytes], toxic: np.ndarray, weight: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], z: np.ndarray) -> BlockMaxIndex:
        """vectors: of each example, its terms (ascending) and their shares, which have a norm of 1 (or 0)."""
        heavy = np.array([k[x.argmax()] if len(x) else -1 for k, x in vectors], dtype=np.int64)
        peak = np.array([x.max(initial=0) for _, x in vectors])
        rank = np.empty(len(digests), dtype=np.int64)
        rank[np.argsort(np.array(digests, dtype=object), kind="stable")] = np.arange(len(digests))
        order = np.lexsort((rank, -peak, heavy))
        some = [vectors[i] for i in order.tolist()]
        term = np.concatenate([np.zeros(0, dtype=np.int64), *(k for k, _ in some)])
        share = np.concatenate([np.zeros(0), *(x for _, x in some)])
        example = np.repeat(np.arange(len(some)), [len(k) for k, _ in some])
        own, names, told = ragged([len(k) for k, _ in some]), term, share * z[term]
        norm = np.sqrt(np.bincount(example, weights=told * told, minlength=len(some)))
        told = told / np.where(norm > 0, norm, 1)[example]
        term, share, example = term[share > 0], share[share > 0], example[share > 0]
        by = np.argsort(term, kind="stable")
        term, share, example = term[by], share[by], example[by]
        n_blocks = -(-len(some) // BLOCK)
        key = term * max(1, n_blocks) + example // BLOCK
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
        top = np.maximum.reduceat(share, at) if len(at) else share
        return cls([digests[i] for i in order.tolist()], toxic[order], weight[order], rank[order], np.searchsorted(term[at], np.arange(len(z) + 1)), example[at] // BLOCK, top, np.append(at, len(key)), example, share, own, names, told)

    def nearest(self, terms: np.ndarray, shares: np.ndarray, k: int, own: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a cosine above 0 and a digest other than `own`."""
        n = self.first[terms + 1] - self.first[terms]
        entry, by = gather_runs(self.first[terms], n), np.repeat(shares, n)
        blocks = self.block[entry]
        n_blocks = -(-len(self.digests) // BLOCK)
        bound = np.bincount(blocks, weights=self.top[entry] * by, minlength=n_blocks)
        other = np.array([d != own for d in self.digests]) if own in self.digests else True
        cosines = np.zeros(len(self.digests))

        def open_(which: np.ndarray) -> None:
            on = which[blocks]
            e = entry[on]
            if not len(e):
                return
            run = np.flatnonzero(np.append(True, e[1:] != e[:-1] + 1) | np.append(True, by[on][1:] != by[on][:-1]))
            begin, end = self.at[e[run]], self.at[e[np.append(run[1:], len(e)) - 1] + 1]
            p = gather_runs(begin, end - begin)
            cosines[:] += np.bincount(self.example[p], weights=self.share[p] * np.repeat(by[on][run], end - begin), minlength=len(cosines))

        opened = np.zeros(n_blocks, dtype=bool)
        opened[np.argsort(-bound, kind="stable")[:FIRST]] = True
        open_(opened)
        found = np.sort((cosines * other)[cosines * other > 0])
        least = found[-k] if len(found) >= k else 0.0
        rest = ~opened & (bound > 0) & (bound >= least - 1e-12)
        if 2 * rest.sum() > n_blocks:  # the bounds exclude little: whole posting lists, one after another
            begin, end = self.at[self.first[terms]], self.at[self.first[terms + 1]]
            lists = [slice(a, b) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            weight = np.concatenate([self.share[x] for x in lists]) * np.repeat(shares, end - begin)
            cosines = np.bincount(np.concatenate([self.example[x] for x in lists]), weights=weight, minlength=len(cosines))
        elif rest.any():
            open_(rest)
        cosines *= other
        at = np.flatnonzero(cosines > 0)
        if len(at) > 4 * k:
            at = at[cosines[at] >= np.partition(cosines[at], len(at) - k)[len(at) - k]]
        at = at[np.lexsort((self.rank[at], -cosines[at]))[:k]]
        return at, cosines[at]


    def nearness(self, which: np.ndarray, terms: np.ndarray, told: np.ndarray) -> np.ndarray:
        """Cosines of the given examples with a text in the terms that tell the labels apart."""
        weight = np.zeros(len(self.first) - 1)
        weight[terms] = told
        at = [slice(a, b) for a, b in zip(self.own[which].tolist(), self.own[which + 1].tolist(), strict=True)]
        return np.array([self.told[x] @ weight[self.term[x]] for x in at])


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing function with the least weighted squares: pool adjacent violators."""
    pools: list[list[float]] = []  # weight, sum of x, sum of y
    for i in np.argsort(x, kind="stable").tolist():
        pools.append([weight[i], weight[i] * x[i], weight[i] * y[i]])
        while len(pools) > 1 and (pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0] or pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]):
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[1] / p[0] for p in pools]), np.array([p[2] / p[0] for p in pools])


@dataclass
class Model:
    """All that a task needs to score texts. Its size follows from the examples alone."""

    vocabulary: np.ndarray
    idf: np.ndarray  # of each term
    z: np.ndarray
    unseen: float  # idf of a term that no example holds
    index: BlockMaxIndex
    overall: float
    knots: tuple[np.ndarray, np.ndarray] | None
    k: int

    def vector(self, terms: np.ndarray, counts: np.ndarray, rest: float = 0.0) -> np.ndarray:
        """The terms' shares in a text's vector of norm 1; rest: what `counted` gives for its other terms."""
        x = (1 + np.log(counts)) * self.idf[terms]
        return x / np.sqrt((x * x).sum() + rest * self.unseen**2) if len(x) else x

    def vote(self, terms: np.ndarray, counts: np.ndarray, rest: float, own: bytes) -> tuple[float, np.ndarray, np.ndarray]:
        """The share of toxic votes, and the nearest examples with their cosines."""
        x = self.vector(terms, counts, rest)
        at, near = self.index.nearest(terms, x, self.k, own)
        if not len(at):
            return self.overall, at, near
        told = x * self.z[terms]
        norm = np.sqrt((told * told).sum())
        votes = self.index.nearness(at, terms, told / norm if norm else told) ** 2 * self.index.weight[at]
        return float((votes @ self.index.toxic[at] + PRIOR * self.overall) / (votes.sum() + PRIOR)), at, near

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        return np.interp(votes, *self.knots) if self.knots is not None else votes


def _text(x: str | None) -> bytes:
    return (x or "").encode("utf-8", "surrogatepass")


def examples_of(docs: DataFrame, labels: DataFrame, training, per_class: int) -> tuple[DataFrame, list[int]]:
    """Examples (doc_id, toxic, text), and the numbers of training rows with either label."""
    known = labels.where(training & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    some = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    picked = stage(some[0].unionByName(some[1]))  # 2 * per_class rows at most
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return stage(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))), [sizes.get(y, 0) for y in (0, 1)]


def _described(batches):
    """Digests, labels, and distinct terms with their counts: what the driver gets of the examples."""
    for batch in batches:
        texts = [_text(x) for x in batch.column(0).to_pylist()]
        bounds, terms, counts, vocabulary = counted(texts)
        ends = pa.array(bounds.astype(np.int32))
        columns = [
            pa.array([xxhash.xxh3_128_digest(x) for x in texts], pa.binary()),
            batch.column(1),
            pa.ListArray.from_arrays(ends, pa.array(vocabulary[terms].view(np.int64))),
            pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int64))),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["digest", "toxic", "terms", "counts"])


def fit(docs: DataFrame, labels: DataFrame, training, per_class: int = PER_CLASS, k: int = NEAREST) -> Model:
    spark = docs.sparkSession
    small_batches(spark)
    examples, sizes = examples_of(docs, labels, training, per_class)
    got = examples.select("text", "toxic").mapInArrow(_described, "digest binary, toxic int, terms array<long>, counts array<long>").toArrow()
    got = got.sort_by([("digest", "ascending"), ("toxic", "ascending")])  # 2 * per_class rows at most, with distinct terms only
    digests, y = got.column("digest").to_pylist(), got.column("toxic").to_numpy().astype(np.int64)
    lists = got.column("terms").combine_chunks()
    names = lists.flatten().to_numpy().astype(np.int64).view(np.uint64)
    counts = got.column("counts").combine_chunks().flatten().to_numpy()
    bounds = ragged(lists.value_lengths().to_numpy())
    vocabulary, terms = np.unique(names, return_inverse=True)
    n = np.bincount(y, minlength=2)
    seen = [np.bincount(terms[np.repeat(y == v, np.diff(bounds))], minlength=len(vocabulary)) for v in (0, 1)]
    p = (seen[0] + seen[1] + 1) / (len(y) + 2)
    z = np.abs(seen[1] / max(1, n[1]) - seen[0] / max(1, n[0])) / np.sqrt(p * (1 - p) * (1 / max(1, n[1]) + 1 / max(1, n[0])))
    total, df = document_frequencies(docs, vocabulary)
    overall = sizes[1] / max(1, sum(sizes))
    weight = np.array([sizes[v] / max(1, sum(sizes)) * len(y) / max(1, n[v]) for v in (0, 1)])
    model = Model(vocabulary, np.log((1 + total) / (1 + df)) + 1, z, float(np.log(1 + total) + 1), None, overall, None, k)
    own = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
    model.index = BlockMaxIndex.build(digests, y, weight[y], [(terms[a:b], model.vector(terms[a:b], counts[a:b])) for a, b in own], z)
    if n.all():
        votes = np.array([model.vote(terms[a:b], counts[a:b], 0.0, d)[0] for (a, b), d in zip(own, digests, strict=True)])
        model.knots = isotonic(votes, y.astype(float), weight[y])
    return model


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of documents, and of those with each term of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        n, seen = 0, np.zeros(len(shared.value), dtype=np.int64)
        for batch in batches:
            n += batch.num_rows
            _, terms, _, _ = counted(batch.column(0), shared.value)
            seen += np.bincount(terms, minlength=len(seen))
        on = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(on, -1), pa.int32()), pa.array(np.append(seen[on], n))], names=["term", "n"])

    # one row a term from each task; the driver gets one a term
    got = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = got.column("term").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(len(vocabulary))
    out[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), out


def score(docs: DataFrame, labels: DataFrame, training, per_class: int = PER_CLASS, k: int = NEAREST, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, and as evidence the cosines and labels of the nearest examples.

    training: a condition on labels' rows that may be learnt from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, training, per_class, k))

    def run(batches):
        model, known = shared.value, {}
        for batch in batches:
            texts = [_text(x) for x in batch.column(1).to_pylist()]
            bounds, terms, counts, _, rest = counted(texts, model.vocabulary, rest=True)
            votes, cosines, toxic = [], [], []
            for text, a, b, other in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), rest.tolist(), strict=True):
                digest = xxhash.xxh3_128_digest(text)
                if digest not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[digest] = model.vote(terms[a:b], counts[a:b], other, digest)
                vote, at, near = known[digest]
                votes.append(vote)
                cosines.append(near)
                toxic.append(model.index.toxic[at])
            scores = model.calibrated(np.array(votes))
            ends = pa.array(ragged([len(x) for x in cosines]).astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0), *cosines]))),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *toxic]))),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), *lists], names=["doc_id", "score", "predicted", "cosines", "labels"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int, cosines array<double>, labels array<long>")


def held_out_scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Scores learnt from the rows whose crc32 of doc_id leaves another remainder than 2 by 4."""
    out = score(docs, labels, crc_mod("doc_id", 4) != 2, **options)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted", "cosines", "labels")


def reject(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not predicted to be toxic. Rows of one doc_id go together; ids that are null stay or go
    together too."""
    bad = held_out_scores(docs, labels, **options).where("predicted = 1").select("doc_id").distinct()
    left, right = docs.alias("left"), bad.alias("right")
    return left.join(right, F.col("left.doc_id").eqNullSafe(F.col("right.doc_id")), "left_anti").select("left.*")
