"""Distances between two vectors, smaller is closer.

Every metric has a Column form, which runs inside Spark's expressions, and a block form over numpy arrays. Both add terms from
the first dimension to the last in double precision, so they agree bit by bit, whatever the partitioning.

Conventions: cosine with a zero vector is 1, Jaccard and Sorensen of two empty bit sets are 0, Pearson without variance is 1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(terms: Column) -> Column:
    """Sum of an array of doubles, from the first to the last."""
    return F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)


def _pairs(x: Column, y: Column, f: Callable[[Column, Column], Column]) -> Column:
    return fold(F.zip_with(x, y, lambda a, b: f(a.cast("double"), b.cast("double"))))


def _own(x: Column, f: Callable[[Column], Column]) -> Column:
    return fold(F.transform(x, lambda a: f(a.cast("double"))))


def _l2(x, y):
    return _pairs(x, y, lambda a, b: (a - b) * (a - b))


def _ip(x, y):
    return 1.0 - _pairs(x, y, lambda a, b: a * b)


def _cos(x, y):
    norm = F.sqrt(_own(x, lambda a: a * a) * _own(y, lambda a: a * a))
    return F.when(norm == 0, 1.0).otherwise(1.0 - _pairs(x, y, lambda a, b: a * b) / F.when(norm == 0, 1.0).otherwise(norm))


def _manhattan(x, y):
    return _pairs(x, y, lambda a, b: F.abs(a - b))


def _pearson(x, y):
    n = F.size(x).cast("double")
    sx, sy = _own(x, lambda a: a), _own(y, lambda a: a)
    vx, vy = n * _own(x, lambda a: a * a) - sx * sx, n * _own(y, lambda a: a * a) - sy * sy
    norm = F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))
    return F.when(norm == 0, 1.0).otherwise(1.0 - (n * _pairs(x, y, lambda a, b: a * b) - sx * sy) / F.when(norm == 0, 1.0).otherwise(norm))


def _haversine(x, y):
    (a1, o1), (a2, o2) = ((v[0].cast("double"), v[1].cast("double")) for v in (x, y))
    s, t = F.sin((a2 - a1) / 2), F.sin((o2 - o1) / 2)
    return 2.0 * F.asin(F.least(F.lit(1.0), F.sqrt(s * s + F.cos(a1) * F.cos(a2) * t * t)))


def _divergence(x, y):
    def half(a, b):
        return F.when(a > 0, a * F.ln(F.when(a > 0, 2 * a / (a + b)).otherwise(1.0))).otherwise(0.0)

    return 0.5 * _pairs(x, y, half) + 0.5 * _pairs(y, x, half)


def _bits(x, y, f) -> Column:
    return F.aggregate(F.zip_with(x, y, f), F.lit(0).cast("bigint"), lambda a, v: a + v)


def _hamming(x, y):
    return _bits(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b)).cast("bigint")).cast("double")


def _jaccard(x, y):
    both, any_ = (_bits(x, y, f) for f in (lambda a, b: F.bit_count(a.bitwiseAND(b)).cast("bigint"), lambda a, b: F.bit_count(a.bitwiseOR(b)).cast("bigint")))
    return F.when(any_ == 0, 0.0).otherwise(1.0 - both / F.greatest(any_, F.lit(1)))


def _sorensen(x, y):
    both = _bits(x, y, lambda a, b: F.bit_count(a.bitwiseAND(b)).cast("bigint"))
    sizes = _bits(x, y, lambda a, b: (F.bit_count(a) + F.bit_count(b)).cast("bigint"))
    return F.when(sizes == 0, 0.0).otherwise(1.0 - 2 * both / F.greatest(sizes, F.lit(1)))


#: Queries whose distances from a tile of rows are added up at once.
PART = 16

# ---------------------------------------------------------------- blocks: q (n x d) against b (m x d) -> n x m


def _add(q: np.ndarray, b: np.ndarray, f) -> np.ndarray:
    """Sum over dimensions, first to last; memory holds the result and one term."""
    out = np.zeros((len(q), len(b)))
    for d in range(q.shape[1]):
        out += f(q[:, d, None], b[None, :, d])
    return out


def _squares(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x * x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _b_cos(q, b):
    norm = np.sqrt(_squares(q)[:, None] * _squares(b)[None, :])
    return np.where(norm == 0, 1.0, 1.0 - _add(q, b, np.multiply) / np.where(norm == 0, 1.0, norm))


def _b_pearson(q, b):
    n = float(q.shape[1])
    sq, sb = np.cumsum(q, axis=1)[:, -1], np.cumsum(b, axis=1)[:, -1]
    vq, vb = np.maximum(n * _squares(q) - sq * sq, 0), np.maximum(n * _squares(b) - sb * sb, 0)
    norm = np.sqrt(vq[:, None] * vb[None, :])
    return np.where(norm == 0, 1.0, 1.0 - (n * _add(q, b, np.multiply) - sq[:, None] * sb[None, :]) / np.where(norm == 0, 1.0, norm))


def _b_haversine(q, b):
    s, t = np.sin((b[None, :, 0] - q[:, 0, None]) / 2), np.sin((b[None, :, 1] - q[:, 1, None]) / 2)
    return 2 * np.arcsin(np.minimum(1.0, np.sqrt(s * s + np.cos(q[:, 0, None]) * np.cos(b[None, :, 0]) * t * t)))


def _half(x, y):
    x, y = np.broadcast_arrays(x, y)
    return np.where(x > 0, x * np.log(np.where(x > 0, 2 * x / np.where(x > 0, x + y, 1.0), 1.0)), 0.0)


def _b_divergence(q, b):
    return 0.5 * _add(q, b, _half) + 0.5 * _add(q, b, lambda x, y: _half(y, x))


def _count(q, b, f) -> np.ndarray:
    out = np.zeros((len(q), len(b)), dtype=np.int64)
    for d in range(q.shape[1]):
        out += np.bitwise_count(f(q[:, d, None].view(np.uint64), b[None, :, d].view(np.uint64)))
    return out


def _b_jaccard(q, b):
    both, any_ = _count(q, b, np.bitwise_and), _count(q, b, np.bitwise_or)
    return np.where(any_ == 0, 0.0, 1.0 - both / np.maximum(any_, 1))


def _b_sorensen(q, b):
    both = _count(q, b, np.bitwise_and)
    sizes = np.bitwise_count(q.view(np.uint64)).sum(axis=1, dtype=np.int64)[:, None] + np.bitwise_count(b.view(np.uint64)).sum(axis=1, dtype=np.int64)[None, :]
    return np.where(sizes == 0, 0.0, 1.0 - 2 * both / np.maximum(sizes, 1))


def _g_l2(q, b):
    return (q * q).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (q @ b.T)


def _g_cos(q, b):
    norm = np.sqrt((q * q).sum(axis=1)[:, None] * (b * b).sum(axis=1)[None, :])
    return np.where(norm == 0, 1.0, 1.0 - q @ b.T / np.where(norm == 0, 1.0, norm))


def _l_manhattan(q, b):
    """In single precision, in one buffer, less what rounding can have added."""
    norm = np.abs(q).sum(axis=1).max(initial=0.0) + np.abs(b).sum(axis=1).max(initial=0.0)
    if not norm < 1e30:  # too large for single precision, or not a number
        return METRICS["manhattan"].block(q, b)
    x, y = np.ascontiguousarray(q.T, dtype=np.float32), np.ascontiguousarray(b.T, dtype=np.float32)
    out = np.empty((len(q), len(b)), dtype=np.float32)
    term = np.empty((PART, len(b)), dtype=np.float32)
    for a in range(0, len(q), PART):  # a part stays in the cache
        part, some = out[a : a + PART], term[: min(PART, len(q) - a)]
        part[:] = 0
        for d in range(len(x)):
            np.subtract(x[d, a : a + PART, None], y[d], out=some)
            np.abs(some, out=some)
            part += some
    # each value, difference and sum is wrong by 2^-24 of it at most
    return out - np.float32((q.shape[1] + 8) * 2.0**-23 * norm + 1e-37)


def _l_divergence(q, b):
    """Each term (the gap of x ln x over x, y) is at least ln(2) / 2 times (sqrt(x) - sqrt(y))^2: least where one of them is 0."""
    if not (q.min(initial=0.0) >= 0 and b.min(initial=0.0) >= 0):
        return METRICS["divergence"].block(q, b)
    x, y = np.sqrt(q), np.sqrt(b)
    own, other = q.sum(axis=1), b.sum(axis=1)
    out = x @ y.T
    out *= -2
    out += own[:, None]
    out += other
    out *= 0.5 * np.log(2.0) * (1 - 1e-9)
    return out - 1e-11 * (own.max(initial=0.0) + other.max(initial=0.0))


def _xlogx(x):
    return x * np.log(np.maximum(x, 1e-300))


def _c_divergence(q, b):
    """With the entropies of both sides at hand a pair takes one logarithm a dimension."""
    if not (q.min(initial=0.0) >= 0 and b.min(initial=0.0) >= 0):
        return lambda rows, cols: np.full(len(rows), -np.inf)
    own, other = (0.5 * (_xlogx(x).sum(axis=1) + np.log(2.0) * x.sum(axis=1)) for x in (q, b))
    wide = 1e-11 * sum(np.abs(_xlogx(2 * x)).sum(axis=1).max(initial=0.0) + x.sum(axis=1).max(initial=0.0) for x in (q, b))

    def bound(rows, cols):
        both = q[rows] + b[cols]
        return own[rows] + other[cols] - 0.5 * _xlogx(both).sum(axis=1) - wide

    return bound


def _terms(x: np.ndarray, y: np.ndarray, f) -> np.ndarray:
    """For rows of equal numbers, the sum over dimensions, first to last."""
    out = np.zeros(len(x))
    for a in range(0, len(x), 4096):  # columns of a part lie side by side in the cache
        p, q = np.ascontiguousarray(x[a : a + 4096].T), np.ascontiguousarray(y[a : a + 4096].T)
        for d in range(len(p)):
            out[a : a + 4096] += f(p[d], q[d])
    return out


def _p_cos(x, y):
    norm = np.sqrt(_squares(x) * _squares(y))
    return np.where(norm == 0, 1.0, 1.0 - _terms(x, y, np.multiply) / np.where(norm == 0, 1.0, norm))


@dataclass(frozen=True)
class Metric:
    """column and block agree exactly; quick (if any) is a matrix product that may differ in the last bits, least (if any) a bound
    below block (closer gives a function of pairs with a tighter one), and pairs gives what block gives for the pairs of rows that they propose."""

    column: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]
    bits: bool = False
    quick: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    pairs: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    least: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    closer: Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray, np.ndarray], np.ndarray]] | None = None


METRICS: dict[str, Metric] = {
    "l2": Metric(_l2, lambda q, b: _add(q, b, lambda x, y: (x - y) * (x - y)), quick=_g_l2, pairs=lambda x, y: _terms(x, y, lambda a, b: (a - b) * (a - b))),
    "ip": Metric(_ip, lambda q, b: 1.0 - _add(q, b, np.multiply), quick=lambda q, b: 1.0 - q @ b.T, pairs=lambda x, y: 1.0 - _terms(x, y, np.multiply)),
    "cos": Metric(_cos, _b_cos, quick=_g_cos, pairs=_p_cos),
    "manhattan": Metric(_manhattan, lambda q, b: _add(q, b, lambda x, y: np.abs(x - y)), pairs=lambda x, y: _terms(x, y, lambda a, b: np.abs(a - b)), least=_l_manhattan),
    "pearson": Metric(_pearson, _b_pearson),
    "haversine": Metric(_haversine, _b_haversine),
    "divergence": Metric(_divergence, _b_divergence, pairs=lambda x, y: 0.5 * _terms(x, y, _half) + 0.5 * _terms(x, y, lambda a, b: _half(b, a)), least=_l_divergence, closer=_c_divergence),
    "hamming": Metric(_hamming, lambda q, b: _count(q, b, np.bitwise_xor).astype(float), bits=True),
    "jaccard": Metric(_jaccard, _b_jaccard, bits=True),
    "sorensen": Metric(_sorensen, _b_sorensen, bits=True),
}
ALIASES = {"l2sq": "l2", "euclidean": "l2", "dot": "ip", "inner_product": "ip", "cosine": "cos", "angular": "cos", "l1": "manhattan", "tanimoto": "jaccard", "jensenshannon": "divergence"}


def pair_distances(name: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distance of each row of x from the same row of y."""
    m = metric(name)
    return m.pairs(x, y) if m.pairs else np.array([m.block(x[i : i + 1], y[i : i + 1])[0, 0] for i in range(len(x))])


def near_distances(name: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """About the distance of each row of x from the same row of y, in their own precision: good enough to steer a search."""
    kind = ALIASES.get(name.lower(), name.lower())
    if kind == "l2":
        d = x - y
        return np.einsum("nd,nd->n", d, d)
    if kind in ("ip", "cos"):
        s = np.einsum("nd,nd->n", x, y)
        return 1 - (s if kind == "ip" else s / np.maximum(np.sqrt(np.einsum("nd,nd->n", x, x) * np.einsum("nd,nd->n", y, y)), 1e-30))
    return pair_distances(name, x, y)


def metric(name: str) -> Metric:
    key = ALIASES.get(name.lower(), name.lower())
    if key not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {sorted([*METRICS, *ALIASES])}")
    return METRICS[key]
