"""Order, sampling and placement of base rows, all as functions of the row number.

The order does not depend on partitions or machines: rows are sorted by a mixed hash of the row number and a seed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import stage

#: Two rounds of xor, shift and multiplication over 32 bits; products stay below 2**63.
ROUNDS = ((16, 0x7FEB352D), (15, 0x31848BAB))
MASK = 0xFFFFFFFF


def row_hash(row: Column, seed: int | Column = 42) -> Column:
    """32 mixed bits of a row number of any size."""
    x = row.cast("bigint") + F.lit(seed)
    high = F.shiftright(x, 32)
    x = x.bitwiseAND(F.lit(MASK)).bitwiseXOR((high * F.lit(0x1E3779B1)).bitwiseAND(F.lit(MASK)))
    for shift, factor in ROUNDS:
        x = (x.bitwiseXOR(F.shiftright(x, shift)) * F.lit(factor)).bitwiseAND(F.lit(MASK))
    return x.bitwiseXOR(F.shiftright(x, 16))


def row_hash_sql(row: str, seed: int = 42) -> str:
    """The same in ANSI SQL with bit operators."""
    x = f"(({row}) + {seed})::BIGINT"
    x = f"xor({x} & {MASK}, (({x} >> 32) * {0x1E3779B1}) & {MASK})"
    for shift, factor in ROUNDS:
        x = f"((xor({x}, ({x}) >> {shift}) * {factor}) & {MASK})"
    return f"xor({x}, {x} >> 16)"


def global_rank(df: DataFrame, *order: Column | str, name: str = "perm") -> DataFrame:
    """df with a column of places from 0 in the given order, without one task for all rows.

    Rows are sorted by ranges; the sizes of the ranges before a row's own are added to its place in its range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = ranged.withColumn("__part", F.shiftright("__at", 33)).withColumn("__nth", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = stage(ranged)  # sizes and places must be of one layout, also when executors are lost
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).drop("__n")
    return ranged.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__nth")).drop("__part", "__at", "__nth", "__before")


#: Rounds of the network, and the steps that a place outside the table is followed for.
TURNS, WALK = 6, 40


def _sides(n: int) -> tuple[int, int]:
    """Numbers of rows and columns of the smallest near-square that holds n places."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _network(x: Column, n: int, seed: int, back: bool) -> Column:
    """One pass over a * b places: the row number is shifted by a hash of the column number and the other way round, in turn."""
    a, b = _sides(n)
    sign = F.lit(-1 if back else 1)

    def turn(p: Column, t: Column) -> Column:
        odd = t % 2 == 1
        mixed = row_hash(F.when(odd, p["i"]).otherwise(p["j"]), F.lit(seed) + t)
        i = F.when(odd, p["i"]).otherwise(F.pmod(p["i"] + sign * mixed, F.lit(a)))
        j = F.when(odd, F.pmod(p["j"] + sign * mixed, F.lit(b))).otherwise(p["j"])
        return F.struct(i.cast("bigint").alias("i"), j.cast("bigint").alias("j"))

    j = F.pmod(x, F.lit(b)).cast("bigint")
    begin = F.struct(((x - j) / F.lit(b)).cast("bigint").alias("i"), j.alias("j"))
    turns = F.array(*(F.lit(t) for t in range(TURNS)[:: -1 if back else 1]))
    return F.aggregate(turns, begin, turn, lambda p: p["i"] * F.lit(b) + p["j"])


def _walk(row: Column, n: int, seed: int, back: bool) -> Column:
    x = _network(row.cast("bigint"), n, seed, back)
    # fewer than a of a * b places lie outside the table: WALK steps are enough for certain if a <= WALK, and else but for one in n ** (WALK / 2)
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), x, lambda y, _: F.when(y < n, y).otherwise(_network(y, n, seed, back)))


def permuted(row: Column, n: int, seed: int = 42) -> Column:
    """The place of row 0 .. n - 1 in a keyed permutation of 0 .. n - 1: a Feistel network over a near-square with cycle walking.

    An expression of the row number alone: no sort, no exchange, and `unpermuted` gives the row of a place.
    """
    return _walk(row, n, seed, False)


def unpermuted(place: Column, n: int, seed: int = 42) -> Column:
    """The row that `permuted` has put in a place."""
    return _walk(place, n, seed, True)


def permutation_sql(table: str, row: str, seed: int = 42) -> str:
    """row, place and back (the row itself) in ANSI SQL; cycles are walked by a recursive query."""
    step = "SELECT row, n, a, b, x // b AS i, x % b AS j FROM {0}"
    for t in range(TURNS):
        i, j = ("i", f"(j + {row_hash_sql('i', seed + t)}) % b") if t % 2 else (f"(i + {row_hash_sql('j', seed + t)}) % a", "j")
        step = f"SELECT row, n, a, b, {i} AS i, {j} AS j FROM ({step})"
    once = f"SELECT row, n, a, b, i * b + j AS x FROM ({step})"
    return f"""WITH RECURSIVE size AS (SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a FROM {table}),
    begin AS (SELECT {row} AS row, n, a, CAST(ceil(n / a) AS BIGINT) AS b, {row} AS x FROM {table}, size),
    walk AS ({once.format("begin")} UNION ALL {once.format("(SELECT * FROM walk WHERE x >= n)")})
    SELECT row, x AS place, row AS back FROM walk WHERE x < n"""


def insertion_order(base: DataFrame, row: str = "row", seed: int = 42, shuffle: bool = True) -> DataFrame:
    """perm: the place of each row in the order of insertion."""
    if not shuffle:
        return base.withColumn("perm", F.col(row))
    return global_rank(base.withColumn("__h", row_hash(F.col(row), seed)), "__h", row).drop("__h")


def sample(base: DataFrame, n: int, row: str = "row", seed: int = 42) -> DataFrame:
    """n rows without replacement, in random order."""
    return base.withColumn("__h", row_hash(F.col(row), seed)).orderBy("__h", row).limit(n).drop("__h")


def gather(base: DataFrame, rows: DataFrame, row: str = "row") -> DataFrame:
    """The base rows with the numbers in rows (place, row), in their places; a number given twice gives two rows, one
    that the base does not have gives none."""
    return rows.select("place", row).join(base, row)


def sliced(base: DataFrame, first: int, last: int, row: str = "row") -> DataFrame:
    """Rows first .. last - 1; a condition that sources prune by."""
    if first < 0 or last < first:
        raise ValueError(f"no rows {first}..{last}")
    return base.where((F.col(row) >= first) & (F.col(row) < last))


def capped(base: DataFrame, rows: int | None, row: str = "row") -> DataFrame:
    """The first `rows` rows by number, all if None."""
    return base if rows is None else sliced(base, 0, rows, row)


def shard_of(place: Column, shards: int) -> Column:
    return F.pmod(place, F.lit(shards))


def shard_offsets(shards: DataFrame) -> DataFrame:
    """shards (shard, rows) with the number of rows before each shard; one row a shard."""
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("offset", F.coalesce(F.sum("rows").over(w), F.lit(0)).cast("bigint"))


def locate(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """(row) to (row, shard, local): the shard that holds a global row, and its place there."""
    ends = offsets.withColumn("end", F.col("offset") + F.col("rows"))
    hit = (rows["row"] >= ends["offset"]) & (rows["row"] < ends["end"])
    return rows.join(F.broadcast(ends), hit).select("row", "shard", (F.col("row") - F.col("offset")).alias("local"))


def epoch_of(perm: Column, total: int, epochs: int) -> Column:
    """Epoch (from 0) in which a row is inserted: steps of ceil(total / epochs) rows."""
    return F.floor(perm / F.lit(max(1, -(-total // epochs)))).cast("bigint")


def epoch_sizes(total: int, epochs: int) -> list[tuple[int, int, int]]:
    """(epoch, first row, rows); epochs beyond the last row are empty."""
    if epochs < 1:
        raise ValueError("epochs must be at least 1")
    step = -(-total // epochs)
    return [(e, min(e * step, total), max(0, min(step, total - e * step))) for e in range(epochs)]
