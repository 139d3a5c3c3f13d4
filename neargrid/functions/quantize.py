"""Numeric precisions and quantizations of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name: (exponent bits, mantissa bits, bias, largest value). e5m2 keeps infinities out by saturating.
SMALL_FLOATS = {"e5m2": (5, 2, 15, 57344.0), "e4m3": (4, 3, 7, 448.0), "e3m2": (3, 2, 3, 28.0), "e2m3": (2, 3, 1, 7.5)}
INTEGERS = {"i8": (-128, 127, "tinyint"), "u8": (0, 255, "smallint")}


#: Bits of an element, and its name on the wire (none: not sent as such).
TYPES = {
    "f64": (64, "FLOAT64"),
    "f32": (32, "FLOAT32"),
    "bf16": (16, "BFLOAT16"),
    "f16": (16, "FLOAT16"),
    "e5m2": (8, None),
    "e4m3": (8, None),
    "e3m2": (6, None),
    "e2m3": (6, None),
    "i8": (8, "INT8"),
    "u8": (8, "UINT8"),
    "b1": (1, None),
}


def data_type(name: str, allowed: tuple[str, ...] = tuple(TYPES)) -> str:
    """A type's name, if a backend that knows `allowed` supports it."""
    if name not in TYPES or name not in allowed:
        raise ValueError(f"unknown data type {name!r}; supported: {', '.join(allowed)}")
    return name


def cast(vector: Column, name: str) -> Column:
    """A vector as elements of a type: integers clamp and truncate, floats round to the nearest."""
    if data_type(name, tuple(t for t in TYPES if t != "b1")) in INTEGERS:
        return to_integer(vector, name)
    return vector.cast("array<double>") if name == "f64" else at_precision(vector, name)


def truncated(vector: Column, dims: int) -> Column:
    """The leading dimensions."""
    return F.slice(vector, 1, dims)


def check_dims(dims: int, native: int, bits: bool = False) -> int:
    if not 0 < dims <= native:
        raise ValueError(f"dimensions must be in 1..{native}, not {dims}")
    if bits and dims % 8:
        raise ValueError(f"bit vectors are cut at whole bytes; {dims} is no multiple of 8")
    return dims


def widened(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("float"))


def to_integer(vector: Column, name: str, scale: float = 1.0) -> Column:
    """Clamp, then truncate toward zero. The clamp comes first, as casts beyond the range raise."""
    low, high, kind = INTEGERS[name]
    return F.transform(vector, lambda x: F.greatest(F.least(x.cast("double") * F.lit(float(scale)), F.lit(float(high))), F.lit(float(low))).cast(kind))


def sign_words(vector: Column, dims: int) -> Column:
    """Bits x > 0, in 64-bit words, the first dimension in the lowest bit."""

    def word(start: int) -> Column:
        part = F.slice(vector, start + 1, min(64, dims - start))
        bits = F.transform(part, lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")))
        return F.aggregate(F.zip_with(bits, F.sequence(F.lit(0), F.lit(min(64, dims - start) - 1)), lambda b, i: F.call_function("shiftleft", b, i)), F.lit(0).cast("bigint"), lambda a, v: a.bitwiseOR(v))

    return F.array(*[word(s) for s in range(0, dims, 64)])


def rounded_sql(x: str, name: str) -> str:
    """The value of `rounded` in DuckDB's SQL."""
    e, m, bias, top = {"f16": (5, 10, 15, 65504.0), "bf16": (8, 7, 127, 3.3895313892515355e38), **SMALL_FLOATS}[name]
    step = f"pow(2.0::DOUBLE, greatest(floor(log2(abs(CAST({x} AS DOUBLE)))), {1 - bias}) - {m})"
    return f"CASE WHEN {x} = 0 THEN 0.0::DOUBLE ELSE sign({x}) * least({top!r}::DOUBLE, CAST(round_even(abs(CAST({x} AS DOUBLE)) / {step}, 0) AS DOUBLE) * {step}) END"


def grid(name: str) -> np.ndarray:
    """All finite values of a small float, ascending."""
    e, m, bias, top = SMALL_FLOATS[name]
    codes = np.arange(1 << (e + m))
    exponent, mantissa = codes >> m, codes & ((1 << m) - 1)
    values = np.where(exponent == 0, mantissa * 2.0 ** (1 - bias - m), (1 + mantissa * 2.0**-m) * 2.0 ** (exponent - bias))
    values = values[values <= top]
    return np.unique(np.concatenate([-values, values]))


def rounded(x: np.ndarray, name: str) -> np.ndarray:
    """float32 values at a lower precision: nearest value, ties to even, beyond the largest the largest."""
    x = np.asarray(x, dtype=np.float32)
    if name == "f32":
        return x
    if name == "f16":
        return np.clip(x, -65504, 65504).astype(np.float16).astype(np.float32)
    if name == "bf16":
        u = x.view(np.uint32)
        return ((u + 0x7FFF + ((u >> 16) & 1)) & 0xFFFF0000).astype(np.uint32).view(np.float32)
    g = grid(name)
    k = np.clip(np.searchsorted(g, x), 1, len(g) - 1)
    low, high = g[k - 1], g[k]
    even = np.searchsorted(g[g >= 0], np.abs(low)) % 2 == 0
    down = (x - low < high - x) | ((x - low == high - x) & even)
    return np.where(down, low, high).astype(np.float32)


def at_precision(vector: Column, name: str) -> Column:
    """A vector at f16, bf16 or a small float, stored as floats."""
    if name in ("f32", "float32"):
        return vector.cast("array<float>")

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        some = s[s.notna()]
        if not len(some):
            return s
        ends = np.cumsum([len(v) for v in some])
        out = s.copy()
        out[some.index] = pd.Series(np.split(rounded(np.concatenate(some.to_list()), name), ends[:-1]), index=some.index, dtype=object)
        return out

    return run(vector)


def dim_bounds(df: DataFrame, column: str, quantile: float = 1.0, accuracy: int = 100_000) -> DataFrame:
    """Per dimension (dim from 0) the low and high bound that holds `quantile` of the values. One row a dimension.

    The extremes are found in one pass that sends one row a dimension from each task. Other quantiles are values of the data
    whose rank is right to one part in `accuracy` (exactly, for fewer rows), from sketches of bounded size.
    """
    if quantile >= 1:

        def run(batches):
            low = high = None
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    x = x.reshape(batch.num_rows - batch.column(0).null_count, -1)
                    if len(x):
                        low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                        high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
            n = 0 if low is None else len(low)
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([] if low is None else low, pa.float64()), pa.array([] if high is None else high, pa.float64())], names=["dim", "low", "high"])

        parts = df.select(column).mapInArrow(run, "dim int, low double, high double")
        return parts.groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    each = df.select(F.posexplode(column).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    cut = (1 - quantile) / 2
    return each.groupBy("dim").agg(F.percentile_approx("x", F.lit(cut), accuracy).alias("low"), F.percentile_approx("x", F.lit(1 - cut), accuracy).alias("high"))


def unpacked_bits(words: Column, bits: int) -> Column:
    """64-bit words to an array of 0 and 1, the lowest bit first."""
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.call_function("shiftright", words[F.floor(i / 64).cast("int")], (i % 64).cast("int")).bitwiseAND(F.lit(1)).cast("tinyint"))


def scalar_codes(df: DataFrame, column: str, bounds: DataFrame) -> DataFrame:
    """column as 0..255 codes between the bounds of each dimension (affine, clamped, truncated)."""
    row = bounds.agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "low", "high"))), lambda s: F.struct(s["low"].alias("low"), s["high"].alias("high"))).alias("__bounds"))

    def code(x: Column, b: Column) -> Column:
        width = b["high"] - b["low"]
        return F.when(width == 0, 0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x.cast("double") - b["low"]) / F.when(width == 0, 1.0).otherwise(width) * 255.0)).cast("int"))

    # one row, as long as a vector
    return df.crossJoin(F.broadcast(row)).withColumn(column, F.zip_with(column, "__bounds", code)).drop("__bounds")
