"""Nearest-neighbour graphs by descent: neighbours of neighbours are compared until little changes.

Edges are rows (node, nbr, dist, new). A round takes for each node a sample of its new and of its old edges, in both
directions (a reservoir: the `sample` edges with the least hashes), sends the vectors of these neighbours to the node and
compares each new one with all others there. A pair is sent on only if it beats the k-th edge that one of its ends has.
So a row costs the same whatever the number of rows, only edges that are new cause work (rows that are inserted into an
existing graph touch their surroundings only), and hubs are cut down before their rows are shuffled.

`prune` turns such a graph into one for searching: edges that can be replaced by two shorter ones go first, and
edges in the opposite direction fill half of the places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.metrics import ALIASES, metric as find
from ..sources.staging import stage

EDGES = "node long, nbr long, dist double"
#: Bytes of vectors that are compared at once.
TILE_BYTES = 32 << 20


def pack_vectors(df: DataFrame, *names: str) -> DataFrame:
    """df (names..., vector array<float>) with the vectors as bytes of single-precision numbers."""

    def run(batches):
        for batch in batches:
            column = batch.column(len(names))
            flat = column.flatten().to_numpy(zero_copy_only=False).astype("<f4")
            width = 4 * (len(flat) // max(1, len(column)))
            raw = flat.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([raw[i * width : (i + 1) * width] for i in range(len(column))], pa.binary())], names=[*names, "vector"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*names).schema)
    return df.select(*names, F.col("vector").cast("array<float>").alias("vector")).mapInArrow(run, f"{schema}, vector binary")


def unpack(column: pa.Array) -> np.ndarray:
    """Rows of packed vectors as a matrix."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype="<f4").reshape(n, -1 if n else 0).astype(np.float64)


def unpack_vectors(df: DataFrame, *names: str) -> DataFrame:
    """df (names..., vector packed) with the vectors as array<float>."""

    def run(batches):
        for batch in batches:
            x = unpack(batch.column(len(names))).astype(np.float32)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if len(x) else 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=[*names, "vector"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*names).schema)
    return df.select(*names, "vector").mapInArrow(run, f"{schema}, vector array<float>")


def mutual(name: str, x: np.ndarray) -> np.ndarray:
    """Distances within each of many small sets: (sets, members, dims) to (sets, members, members)."""
    kind = ALIASES.get(name.lower(), name.lower())
    if kind in ("l2", "ip", "cos"):
        dots = x @ x.transpose(0, 2, 1)
        if kind == "ip":
            return 1 - dots
        own = np.einsum("gii->gi", dots)
        if kind == "l2":
            return np.maximum(own[:, :, None] + own[:, None, :] - 2 * dots, 0)
        return 1 - dots / np.maximum(np.sqrt(own[:, :, None] * own[:, None, :]), 1e-30)
    m = find(name)
    return np.stack([m.block(s, s) for s in x])


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables in which the runs of a sorted column are whole."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        names = table.column(column).to_numpy()
        cut = int(np.searchsorted(names, names[-1]))  # where the last run begins
        if cut:
            yield pa.concat_tables([*held, table.slice(0, cut)]).combine_chunks()
            held = []
        elif held and held[-1].column(column)[-1].as_py() != names[0]:
            yield pa.concat_tables(held).combine_chunks()
            held = []
        held.append(table.slice(cut))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def spread(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a sorted column: its values, the number of the value of each row, and the row's place within the value."""
    values, first = np.unique(names, return_index=True)
    which = np.searchsorted(values, names)
    return values, which, np.arange(len(names)) - first[which]


def compare_members(members: DataFrame, name: str) -> DataFrame:
    """Edges found among the members (v, u, new, vector, bar) of each node v: (node, nbr, dist) below node's bar."""

    def run(batches):
        for table in runs(batches, "v"):
            v, u = table.column("v").to_numpy(), table.column("u").to_numpy()
            new, bar = table.column("new").to_numpy(zero_copy_only=False), table.column("bar").to_numpy()
            x = unpack(table.column("vector"))
            _, which, place = spread(v)
            sets, width = int(which[-1]) + 1, int(place.max()) + 1
            step = max(1, TILE_BYTES // (8 * width * (x.shape[1] + 3 * width)))
            for a in range(0, sets, step):
                lo, hi = np.searchsorted(which, [a, a + step])
                g, m = which[lo:hi] - a, place[lo:hi]
                count = int(g[-1]) + 1
                wide = np.zeros((count, width, x.shape[1]))
                wide[g, m] = x[lo:hi]
                ids, fresh, bars = np.full((count, width), -1), np.zeros((count, width), dtype=bool), np.full((count, width), -np.inf)
                there = np.zeros((count, width), dtype=bool)
                ids[g, m], fresh[g, m], bars[g, m], there[g, m] = u[lo:hi], new[lo:hi], bar[lo:hi], True
                d = mutual(name, wide)
                ok = (fresh[:, :, None] | fresh[:, None, :]) & there[:, None, :] & (ids[:, :, None] != ids[:, None, :]) & (d < bars[:, :, None])
                s, i, j = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(ids[s, i]), pa.array(ids[s, j]), pa.array(d[s, i, j])], names=["node", "nbr", "dist"])

    return members.repartition("v").sortWithinPartitions("v").select("v", "u", "new", "vector", "bar").mapInArrow(run, EDGES)


def nearest_edges(edges: DataFrame, k: int) -> DataFrame:
    """Each node's k nearest distinct neighbours; an edge that is known already is not new. One shuffle, by node, serves both steps."""
    one = edges.repartition("node").groupBy("node", "nbr").agg(F.min("dist").alias("dist"), F.min("new").alias("new"))
    w = Window.partitionBy("node").orderBy("dist", "nbr")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def descend(rows: DataFrame, edges: DataFrame, k: int, name: str, rounds: int = 5, sample: int = 8, enough: float = 0.02, seed: int = 42) -> DataFrame:
    """Better edges (node, nbr, dist, new) from the given ones. rows: key, vector (packed); k edges a node are kept.

    Ends after `rounds`, or when fewer than `enough` of all edges are new.
    """
    edges = stage(nearest_edges(edges, k))
    for turn in range(rounds):
        if edges.where("new").count() <= enough * edges.count():
            break
        mixed = edges.withColumn("h", F.xxhash64("node", "nbr", F.lit(seed + turn)))
        taken = F.row_number().over(Window.partitionBy("node", "new").orderBy("h", "nbr")) <= sample
        mixed = stage(mixed.withColumn("taken", taken))
        some = mixed.where("taken")
        back = some.withColumn("nth", F.row_number().over(Window.partitionBy("nbr", "new").orderBy("h", "node"))).where(F.col("nth") <= sample)
        members = some.select(F.col("node").alias("v"), F.col("nbr").alias("u"), "new").unionByName(back.select(F.col("nbr").alias("v"), F.col("node").alias("u"), "new"))
        members = members.groupBy("v", "u").agg(F.max("new").alias("new"))
        # a node's members without a new one have been compared before
        members = members.withColumn("any", F.max("new").over(Window.partitionBy("v"))).where("any").drop("any")
        bars = edges.groupBy("node").agg(F.when(F.count("*") >= k, F.max("dist")).otherwise(float("inf")).alias("bar"))
        known = rows.join(bars, rows["key"] == bars["node"], "left").select(F.col("key").alias("u"), "vector", F.coalesce("bar", F.lit(float("inf"))).alias("bar"))
        found = compare_members(members.join(known, "u"), name)
        kept = mixed.select("node", "nbr", "dist", (F.col("new") & ~F.col("taken")).alias("new"))
        edges = stage(nearest_edges(kept.unionByName(found.withColumn("new", F.lit(True))), k))
    return edges


def detours(lists: DataFrame) -> DataFrame:
    """node, nbr, rank and how many two-step ways lead to the neighbour by edges of lower ranks only. lists: node, nbrs (by rank)."""
    each = lists.select("node", F.posexplode("nbrs").alias("rank", "nbr"))
    met = each.join(lists.select(F.col("node").alias("nbr"), F.col("nbrs").alias("far")), "nbr", "left")

    def run(batches):
        for table in runs(batches, "node"):
            node, nbr, rank = (table.column(c).to_numpy() for c in ("node", "nbr", "rank"))
            far = table.column("far").combine_chunks()
            sizes = np.diff(far.offsets.to_numpy()) if len(far) else np.zeros(0, dtype=int)
            flat = far.flatten().to_numpy()
            _, which, _ = spread(node)
            sets, width, deep = int(which[-1]) + 1, int(rank.max()) + 1, max(1, int(sizes.max(initial=0)))
            step = max(1, TILE_BYTES // (width * width * deep))
            for a in range(0, sets, step):
                lo, hi = np.searchsorted(which, [a, a + step])
                g, r = which[lo:hi] - a, rank[lo:hi]
                count = int(g[-1]) + 1
                near, wide = np.full((count, width), -1), np.full((count, width, deep), -2)
                near[g, r] = nbr[lo:hi]
                n = sizes[lo:hi]
                own, start = np.repeat(np.arange(hi - lo), n), np.append(0, np.cumsum(sizes))[lo]
                wide[g[own], r[own], np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = flat[start : start + n.sum()]
                ways = np.zeros((count, width), dtype=np.int64)
                for y in range(1, width):  # edges by way of a nearer neighbour that has y at a lower rank
                    ways[:, y] = (wide[:, :y, : min(y, deep)] == near[:, y, None, None]).any(axis=2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(node[lo:hi]), pa.array(nbr[lo:hi]), pa.array(r.astype(np.int32)), pa.array(ways[g, r])], names=["node", "nbr", "rank", "ways"])

    sorted_ = met.repartition("node").sortWithinPartitions("node", "rank").select("node", "nbr", "rank", "far")
    return sorted_.mapInArrow(run, "node long, nbr long, rank int, ways long")


def ranked_lists(edges: DataFrame) -> DataFrame:
    return edges.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("dist", "nbr"))).alias("s")).select("node", F.col("s.nbr").alias("nbrs"))


def prune(edges: DataFrame, degree: int) -> DataFrame:
    """node, nbr: at most `degree` neighbours a node. Half of the places go to its own edges with the fewest detours, the rest to the
    best edges of others that lead to it, and what is left to its own again."""
    ways = stage(detours(stage(ranked_lists(edges))))
    own = ways.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("ways", "rank", "nbr"))).where(F.col("place") <= degree)
    own = stage(own.select("node", "nbr", "place"))
    back = own.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "place")
    back = back.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("place", "nbr"))).where(F.col("place") <= degree)
    half = degree // 2
    order = F.when(F.col("place") <= half, F.col("place")).otherwise(F.col("place") + degree)  # own: first half, then behind the others
    all_ = own.withColumn("place", order).unionByName(back.withColumn("place", F.col("place") + half))
    one = all_.groupBy("node", "nbr").agg(F.min("place").alias("place"))
    return one.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("place", "nbr"))).where(F.col("nth") <= degree).select("node", "nbr")


def undirected(edges: DataFrame) -> DataFrame:
    """node, nbr of all edges and their opposites, for comparison."""
    return edges.select("node", "nbr").unionByName(edges.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"))).distinct()
