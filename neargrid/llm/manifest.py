"""A Merkle manifest of a table: one digest that vouches for every row, and a proof for each.

A leaf is the digest of a row's fields. Per group (`lang`), leaves in the order of their ids are reduced, `fanout` consecutive ones
at a time (the last run may be shorter, even one), until one node is left, the group's subroot; subroots in the order of
their groups are reduced the same way to the root.

Trees are reduced by superblocks: the index of a node, divided by fanout ** levels, names its bucket, and one call of
applyInPandas takes a bucket of that many nodes `levels` levels up. Buckets' roots are the nodes of the next round, so a tree of n
leaves takes log(n) / log(fanout ** levels) rounds, whatever the size of a group; a bucket has a fixed number of rows, and only the
number of rounds goes to the driver. On the way down, each bucket hands the proof of its root to its nodes, which put
what they need inside the bucket in front of it.

Order: nulls before all else, in groups and ids; groups by their UTF-8 bytes; rows of one id by their leaves, so that equal rows
have places of their own. Null and empty fields have different leaves. Texts are hashed inside the JVM and never leave the task
that reads them. An empty table has no root and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_mod, stage, task_count

FANOUT, LEVELS = 2, 8
#: Bytes of a leaf's row in a shuffle.
LEAF_BYTES = 128


def field(value: Column) -> Column:
    """A field as it goes into a leaf: `-` for null, else its bytes' number, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest_of(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(field(v) for v in values)), 256))


def node(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def climb(digests: list[bytes], fanout: int, levels: int) -> list[list[bytes]]:
    """All levels of a bucket, its own nodes first."""
    out = [digests]
    for _ in range(levels):
        last = out[-1]
        out.append([node(last[a : a + fanout]) for a in range(0, len(last), fanout)])
    return out


def steps_to_root(nodes: int, fanout: int) -> int:
    steps = 0
    while nodes > 1:
        nodes, steps = -(-nodes // fanout), steps + 1
    return steps


def proof_inside(levels: list[list[bytes]], at: int, fanout: int) -> tuple[bytes, bytes]:
    """For one node of a bucket: its siblings level by level, and for each level its place in its run and the run's length."""
    siblings, shape = [], bytearray()
    for row in levels[:-1]:
        run = row[at - at % fanout : at - at % fanout + fanout]
        siblings += run[: at % fanout] + run[at % fanout + 1 :]
        shape += bytes((at % fanout, len(run)))
        at //= fanout
    return b"".join(siblings), bytes(shape)


def fold(digest: bytes, siblings: bytes, shape: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    a = 0
    for place, size in zip(shape[::2], shape[1::2], strict=True):
        run = [siblings[b : b + 32] for b in range(a, a + 32 * (size - 1), 32)]
        digest, a = node(run[:place] + [digest] + run[place:]), a + 32 * (size - 1)
    return digest


def indexed(rows: DataFrame, group: str, order: list[Column | str]) -> DataFrame:
    """rows with grp (the group's text), at (place within the group, from 0) and nodes (rows of the group).

    Rows are sorted by ranges over all groups; a group's places go on from range to range by the sizes of its parts, one row for
    each range and group.
    """
    parts = task_count(rows.sparkSession, rows.count() * LEAF_BYTES)
    by = [F.asc_nulls_first(group), *order]
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    ranged = stage(ranged.withColumn("part", F.shiftright("__id", 33)).withColumn("nth", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id"))
    sizes = ranged.groupBy("part", group).agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    w = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("part").alias("__part"), F.col(group).alias("__group"), (before - F.col("first")).alias("shift"), F.sum("n").over(w).alias("nodes"))
    met = ranged.join(sizes, (ranged["part"] == sizes["__part"]) & ranged[group].eqNullSafe(sizes["__group"]))
    return met.withColumn("at", F.col("nth") + F.col("shift")).drop("part", "nth", "shift", "__part", "__group")


def reduce_once(level: DataFrame, fanout: int, levels: int) -> DataFrame:
    """grp, at, nodes, digest of the roots of all buckets. A group of one bucket ends at its root."""
    width = fanout**levels

    def collapse(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes = int(rows["nodes"].iloc[0])
        up = levels if nodes > width else steps_to_root(nodes, fanout)
        root = climb(list(rows.sort_values("at")["digest"]), fanout, up)[-1]
        return pd.DataFrame({"grp": [key[0]], "at": [key[1]], "nodes": [-(-nodes // width)], "digest": root})

    keyed = level.select("grp", "at", "nodes", "digest", F.expr(f"at div {width}L").alias("bucket"))
    return keyed.groupBy("grp", "bucket").applyInPandas(collapse, "grp string, at long, nodes long, digest binary")


SHAPE = "siblings binary, shape binary, root binary, subroot binary"


def hand_down(level: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """level with the proofs of its nodes: what they need inside their buckets, and then the proofs of the buckets' roots."""
    width = fanout**levels
    names = [c for c in level.columns if c not in ("nodes", "siblings", "shape", "root", "subroot")]

    def extend(key, rows: pa.Table, upper: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        nodes, top = rows.column("nodes")[0].as_py(), upper.to_pylist()[0]
        tree = climb(rows.column("digest").to_pylist(), fanout, levels if nodes > width else steps_to_root(nodes, fanout))
        own = [proof_inside(tree, i, fanout) for i in range(len(rows))]
        more = [[s + top["siblings"] for s, _ in own], [s + top["shape"] for _, s in own], [top["root"]] * len(own), [top["subroot"]] * len(own)]
        return pa.Table.from_arrays([*rows.select(names).columns, *(pa.array(x, pa.binary()) for x in more)], names=[*names, "siblings", "shape", "root", "subroot"])

    low = level.select(*names, "nodes", F.expr(f"at div {width}L").alias("bucket")).groupBy("grp", "bucket")
    high = above.select("grp", F.col("at").alias("bucket"), "siblings", "shape", "root", "subroot").groupBy("grp", "bucket")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in level.select(*names).schema)
    return low.cogroup(high).applyInArrow(extend, f"{schema}, {SHAPE}")


def _rounds(level: DataFrame, width: int) -> int:
    """Rounds until every group is one node: follows from the largest group."""
    nodes, rounds = level.agg(F.max("nodes")).first()[0] or 1, 1
    while nodes > width:
        nodes, rounds = -(-nodes // width), rounds + 1
    return rounds


def tree(level: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The levels of all groups, a superblock apart; the last has one node a group."""
    out = [level]
    for _ in range(_rounds(level, fanout**levels)):
        out.append(stage(reduce_once(out[-1], fanout, levels)))
    return out


def _down(steps: list[DataFrame], proofs: DataFrame, fanout: int, levels: int) -> DataFrame:
    for level in reversed(steps[:-1]):
        proofs = hand_down(level, proofs, fanout, levels)
    return proofs


def proofs(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """For rows grp, at, nodes, digest and others (see `indexed`): the same with the columns of SHAPE."""
    steps = tree(leaves, fanout, levels)
    roots = indexed(steps[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), "grp", ["name"])
    tops = tree(stage(roots), fanout, levels)
    none = F.lit(b"")
    root = tops[-1].select("grp", "at", none.alias("siblings"), none.alias("shape"), F.col("digest").alias("root"), F.col("digest").alias("subroot"))
    upper = _down(tops, root, fanout, levels)
    # each group's root as the only node of its last level
    start = upper.select(F.col("name").alias("grp"), F.lit(0).cast("bigint").alias("at"), "siblings", "shape", "root", F.col("digest").alias("subroot"))
    return _down(steps, stage(start), fanout, levels)


def tampered(docs: DataFrame, modulus: int = 7) -> Column:
    """n_chars as someone has changed it: one more in the rows whose id has a checksum divisible by modulus."""
    return F.when(crc_mod("doc_id", modulus) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))


def leaf_table(docs: DataFrame) -> DataFrame:
    """doc_id, grp, leaf and, where it differs, the leaf of the tampered row."""
    fields = lambda n: [F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")]
    changed = F.when(tampered(docs) != F.col("n_chars"), digest_of(*fields(tampered(docs))))
    grp = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang")))
    return docs.select("doc_id", grp.alias("grp"), digest_of(*fields(F.col("n_chars"))).alias("leaf"), changed.alias("changed"))


def row_proofs(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, changed, grp, at, digest (the leaf) and the columns of SHAPE for each row."""
    leaves = stage(leaf_table(docs)).withColumnRenamed("leaf", "digest")
    return proofs(stage(indexed(leaves, "grp", [F.asc_nulls_first("doc_id"), "digest"])), fanout, levels)


REPORT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verify(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, digest of the proof, the root that the (tampered) row leads to, and whether it is the root."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, changed, siblings, shape, root, subroot = (c.to_pylist() for c in batch.columns[1:])
            folded = [fold(c or d, s, h) for d, c, s, h in zip(leaf, changed, siblings, shape, strict=True)]
            shown = [[x.hex() for x in y] for y in (leaf, subroot, root)]
            shown += [[hashlib.sha256(s.hex().encode()).hexdigest() for s in siblings], [f.hex() for f in folded]]
            same = [f == r for f, r in zip(folded, root, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in shown), pa.array(same, pa.bool_())], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    found = row_proofs(docs.select(F.col("doc_id").cast("long"), "source", "lang", "n_chars", "text"), fanout, levels)
    return found.select("doc_id", "digest", "changed", "siblings", "shape", "root", "subroot").mapInArrow(check, REPORT)
