"""Approximate neighbours by a layered neighbour graph that grows with what is added.

Upper layer: a row is a centre if its hash is below a bound, so one in `block_rows` rows is, in whatever order rows come; every
row belongs to the list of its nearest centre, and lists that are larger than a block (many equal rows) are cut into several.
Lower layer: one graph over all rows, found by descent (`descent`), pruned, and stored as one row for each block:
vectors, edges inside the block, and edges that lead to other blocks.

An addition moves rows to centres that have come nearer, takes each new row's first edges from its block, and lets descent
spread these through the graph that is there; edges of rows far from all new ones cause no work.

A search works on blocks of queries of bounded size, which travel to the graph; the graph itself is never shuffled. A query enters the blocks
of its nearest centres, which are compared whole if they are small (one matrix product) and walked by a beam if not. Where the best
rows found so far have edges into blocks that the query has not seen, it enters these at the edges' ends, for at most
`hops` more rounds. How many lists a query enters first is measured at the end of each addition: the true neighbours of SAMPLE rows,
found by a scan, lie in so many of the nearest lists. On rows without structure that is most of them, and nothing beats the scan.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.metrics import metric as find
from ..functions.metrics import near_distances, pair_distances
from ..sources.staging import stage
from .descent import descend, pack_vectors, prune, unpack, unpack_vectors
from .knn import QUERY_BYTES, Scan, knn, matrix, query_blocks, top_k
from .sampling import row_hash

#: Rows of a block at which every search of it begins, queries that a beam walks at once, edges by which a query enters a block.
ENTRIES, QUERIES, DOORS = 32, 256, 4
#: Centres at most: their number is bounded as each task holds them all. Beyond, lists are cut into more blocks, and edges
#: between these lead on.
MAX_CENTRES = 1 << 16
#: Blocks of a list that a query enters at first, and results of a block from which edges to others are followed.
ENTER, FOLLOW = 2, 16
#: Rows of a block that is compared whole; rows whose neighbours are looked up to set `probes`, and how many of each.
SCAN_ROWS, SAMPLE, SAMPLE_K = 8_192, 256, 10
#: Share of allowed rows below which they are compared one by one.
THIN = 0.05
#: Further lists in which a new row looks for its first edges.
VISITS = 2


def asdict_simple(x) -> dict:
    return {k: v for k, v in x.__dict__.items() if isinstance(v, int | float | str)}


def save_meta(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")


def beam_search(x: np.ndarray, ends: np.ndarray, links: np.ndarray, asked: np.ndarray, name: str, width: int, k: int, doors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and distances of the k nearest rows that a beam of `width` finds in a graph, for all queries at once, and how
    many distances each query took.

    links: the neighbours of row i at ends[i] .. ends[i + 1]; doors: more rows to begin at, for each query (-1: none). Each step expands the
    eight nearest rows not yet expanded. Single precision steers; what the beam holds in the end is scored exactly.
    """
    exact = x, asked
    x, asked = x.astype(np.float32), asked.astype(np.float32)
    n, q = len(x), len(asked)
    start = np.unique(np.linspace(0, n - 1, ENTRIES).astype(int))
    pool = np.tile(start, (q, 1))
    if doors is not None and doors.shape[1]:
        pool = np.concatenate([pool, doors], axis=1)
    seen, done = np.zeros((q, n), dtype=bool), np.zeros((q, n), dtype=bool)
    mark = np.zeros((q, n), dtype=np.int32)
    dist = np.full(pool.shape, np.inf)
    for c in range(pool.shape[1]):  # a row that is there twice counts once
        on = np.flatnonzero(pool[:, c] >= 0)
        on = on[~seen[on, pool[on, c]]]
        seen[on, pool[on, c]] = True
        dist[on, c] = near_distances(name, asked[on], x[pool[on, c]])
    pool = np.maximum(pool, 0)
    while True:
        order = np.argsort(dist, axis=1, kind="stable")[:, :width]
        pool, dist = np.take_along_axis(pool, order, axis=1), np.take_along_axis(dist, order, axis=1)
        fresh = np.isfinite(dist) & ~np.take_along_axis(done, pool, axis=1)
        fresh &= np.cumsum(fresh, axis=1) <= 8
        rows, at = np.nonzero(fresh)
        if not len(rows):
            rows, at = np.nonzero(np.isfinite(dist))
            out = np.full(dist.shape, np.inf)
            out[rows, at] = pair_distances(name, exact[1][rows], exact[0][pool[rows, at]])
            order = np.lexsort((pool, out), axis=1)[:, :k]
            return np.take_along_axis(pool, order, axis=1), np.take_along_axis(out, order, axis=1), seen.sum(axis=1)
        done[rows, pool[rows, at]] = True
        node = pool[rows, at]
        size = ends[node + 1] - ends[node]
        last = np.cumsum(size)
        what = links[np.arange(last[-1]) + np.repeat(ends[node] - last + size, size)]
        who = np.repeat(rows, size)
        new = ~seen[who, what]
        who, what = who[new], what[new]
        # a row that several of a query's rows lead to counts once: the last to mark it
        mark[who, what] = np.arange(len(who))
        new = mark[who, what] == np.arange(len(who))
        who, what = who[new], what[new]
        seen[who, what] = True
        found = near_distances(name, asked[who], x[what])
        # one more column for each new row of a query
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        wide = int(nth.max(initial=-1)) + 1
        more, far = np.zeros((q, wide), dtype=np.int64), np.full((q, wide), np.inf)
        more[who, nth], far[who, nth] = what, found
        pool, dist = np.concatenate([pool, more], axis=1), np.concatenate([dist, far], axis=1)


def scan(x: np.ndarray, asked: np.ndarray, name: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `beam_search` gives, from all rows of a block at once."""
    d = (find(name).quick or find(name).block)(asked, x)
    some = min(k, len(x))
    at = np.argpartition(d, some - 1, axis=1)[:, :some]
    dist = np.take_along_axis(d, at, axis=1)
    order = np.lexsort((at, dist), axis=1)
    return np.take_along_axis(at, order, axis=1), np.take_along_axis(dist, order, axis=1), np.full(len(asked), len(x))


ROWS = "list long, gap double, key long, vector binary, fresh boolean"
BLOCK = "unit long, rows int, keys binary, vectors binary, ends binary, links binary, cross_ends binary, cross_keys binary, cross_units binary"
STEP = "kind int, query long, unit long, key long, dist double"
RESULT, COST = 0, 1


def _csr(owner: np.ndarray, n: int) -> np.ndarray:
    return np.append(0, np.cumsum(np.bincount(owner, minlength=n))).astype(np.int64)


@dataclass
class Route:
    """Which queries of a block of queries enter which blocks: parallel arrays in the order of units; door: a row's key or -1."""

    unit: np.ndarray
    query: np.ndarray
    door: np.ndarray

    @classmethod
    def of(cls, unit, query, door) -> Route:
        order = np.lexsort((query, unit))
        return cls(*(np.asarray(a, dtype=np.int64)[order] for a in (unit, query, door)))

    def at(self, unit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The queries that enter a block, and all (place among these, door)."""
        a, b = np.searchsorted(self.unit, [unit, unit + 1])
        some, place = np.unique(self.query[a:b], return_inverse=True)
        return some, place, self.door[a:b]


@dataclass
class GraphIndex:
    """connectivity: edges of a row that are stored; intermediate: edges that descent keeps; expansion_search: width of the beam
    (at least k); block_rows: rows for each centre; probes: centres whose lists a query enters first (0: as many as hold the share
    `reach` of the neighbours of a sample); fan: blocks that it enters in a later round."""

    metric: str = "l2"
    connectivity: int = 16
    intermediate: int = 24
    expansion_search: int = 96
    block_rows: int = 10_000
    probes: int = 0
    reach: float = 0.95
    hops: int = 1
    fan: int = 4
    rounds: int = 5
    seed: int = 42
    dims: int = 0
    centres: np.ndarray | None = field(default=None, repr=False)
    enough: int = 1
    units: dict[int, int] = field(default_factory=dict, repr=False)
    rows: DataFrame | None = field(default=None, repr=False)
    edges: DataFrame | None = field(default=None, repr=False)
    blocks: DataFrame | None = field(default=None, repr=False)

    # ------------------------------------------------------------ building

    def _more_centres(self, fresh: DataFrame) -> np.ndarray:
        have = 0 if self.centres is None else len(self.centres)
        order = [row_hash(F.col("key"), self.seed), F.col("key")]
        some = fresh.where(order[0] < F.lit(max(1, (1 << 32) // self.block_rows))).orderBy(*order).limit(max(0, MAX_CENTRES - have))
        found = [r["vector"] for r in some.select("vector").collect()]  # MAX_CENTRES rows at most
        if not found and not have:
            found = [r["vector"] for r in fresh.orderBy(*order).limit(1).select("vector").collect()]
        return np.frombuffer(b"".join(found), dtype="<f4").reshape(len(found), -1).astype(np.float64)

    def _assign(self, rows: DataFrame, more: np.ndarray, first: int) -> DataFrame:
        """rows in the lists of their nearest centres, where `more` are centres that have come (numbered from first)."""

        def run(batches):
            for batch in batches:
                lists, gaps = batch.column(0).to_numpy().copy(), batch.column(1).to_numpy().copy()
                if len(more):
                    d = find("l2").quick(unpack(batch.column(3)), more)
                    near = d.argmin(axis=1)
                    best = d[np.arange(len(d)), near]
                    on = best < gaps
                    lists[on], gaps[on] = near[on] + first, best[on]
                yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(gaps), *batch.columns[2:]], names=batch.schema.names)

        return rows.mapInArrow(run, ROWS)

    def _visits(self, fresh: DataFrame) -> DataFrame:
        """list, key, vector: new rows in the lists of their next nearest centres, so that first edges join lists."""
        centres, more = self.centres, min(VISITS, len(self.centres) - 1)

        def run(batches):
            for batch in batches:
                d = find("l2").quick(unpack(batch.column(1)), centres)
                near = np.argsort(d, axis=1, kind="stable")[:, 1 : more + 1]
                of = pa.array(np.repeat(np.arange(len(d)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int64)), batch.column(0).take(of), batch.column(1).take(of)], names=["list", "key", "vector"])

        return fresh.select("key", "vector").mapInArrow(run, "list long, key long, vector binary")

    def _first_edges(self, rows: DataFrame) -> DataFrame:
        """Edges of each new row to the nearest rows that are at home in its blocks, and from old rows back."""
        k, name = self.intermediate, self.metric

        def build(key: tuple, table: pa.Table) -> pa.Table:
            keys, fresh, home = (table.column(c).to_numpy() for c in ("key", "fresh", "home"))
            order = np.argsort(~home, kind="stable")  # those at home come first
            keys, fresh, home, table = keys[order], fresh[order], home[order], table.take(pa.array(order))
            x, quick = unpack(table.column("vector")), find(name).quick or find(name).block
            out = [(np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),)]
            y = x[: home.sum()]
            own, w = np.flatnonzero(fresh), min(k, len(y) - 1)
            for a in range(0, len(own) if w > 0 else 0, 1024):
                i = own[a : a + 1024]
                d = quick(x[i], y)
                at = np.flatnonzero(home[i])
                d[at, i[at]] = np.inf
                j = np.argpartition(d, w - 1, axis=1)[:, :w]
                i, j, dist = np.repeat(i, w), j.ravel(), np.take_along_axis(d, j, axis=1).ravel()
                old = ~fresh[j]
                out += [(keys[i], keys[j], dist), (keys[j[old]], keys[i[old]], dist[old])]
            return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["node", "nbr", "dist"])

        return rows.select("unit", "key", "vector", "fresh", "home").groupBy("unit").applyInArrow(build, "node long, nbr long, dist double")

    def _pack(self, rows: DataFrame, links: DataFrame) -> DataFrame:
        """One row for each block."""

        def build(key: tuple, own: pa.Table, edges: pa.Table) -> pa.Table:
            if not own.num_rows:
                return pa.table({})
            unit, own = key[0].as_py(), own.sort_by("key")
            keys, n = own.column("key").to_numpy(), own.num_rows
            node, nbr, far = (edges.column(c).to_numpy() for c in ("node", "nbr", "nbr_unit"))
            order = np.lexsort((nbr, node))
            at, nbr, far = np.searchsorted(keys, node[order]), nbr[order], far[order]
            near = far == unit
            inside = np.searchsorted(keys, nbr[near]).astype(np.int32)
            parts = [keys.astype(np.int64), unpack(own.column("vector")).astype("<f4"), _csr(at[near], n), inside, _csr(at[~near], n), nbr[~near].astype(np.int64), far[~near].astype(np.int64)]
            return pa.table([pa.array([unit]), pa.array([n], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names=[c.split()[0] for c in BLOCK.split(", ")])

        place = rows.select("key", "unit")
        met = links.join(place.withColumnsRenamed({"key": "node"}), "node").join(place.withColumnsRenamed({"key": "nbr", "unit": "nbr_unit"}), "nbr")
        met = met.select(*(F.col(c).alias(c) for c in ("unit", "node", "nbr", "nbr_unit")))
        return rows.select("unit", "key", "vector").groupBy("unit").cogroup(met.groupBy("unit")).applyInArrow(build, BLOCK)

    def add(self, base: DataFrame) -> None:
        """Put rows (key, vector) into the graph. Keys are distinct over all additions."""
        fresh = stage(pack_vectors(base.select(F.col("key").cast("long"), "vector"), "key"))
        one = fresh.select("vector").first()
        if one is None:
            return
        self.dims = len(one["vector"]) // 4
        more, first = self._more_centres(fresh), 0 if self.centres is None else len(self.centres)
        self.centres = more if self.centres is None else np.concatenate([self.centres, more])
        if first:  # new rows look at all centres, old ones at those that have come
            placed = self._assign(fresh.select(F.lit(-1).cast("bigint").alias("list"), F.lit(float("inf")).alias("gap"), "key", "vector", F.lit(True).alias("fresh")), self.centres, 0)
            old = self._assign(self.rows.select("list", "gap", "key", "vector", F.lit(False).alias("fresh")), more, first)
            placed = old.unionByName(placed)
        else:
            placed = self._assign(fresh.select(F.lit(-1).cast("bigint").alias("list"), F.lit(float("inf")).alias("gap"), "key", "vector", F.lit(True).alias("fresh")), more, 0)
        placed = stage(placed)
        sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / (2 * self.block_rows)).cast("bigint").alias("cut"))
        self.units = {r["list"]: r["cut"] for r in sizes.collect()}  # one for each centre
        in_units = lambda df: df.join(F.broadcast(sizes), "list").withColumn("unit", F.shiftleft("list", 32) + F.pmod(F.xxhash64("key"), "cut")).drop("cut")
        self.rows = rows = stage(in_units(placed))
        guests = in_units(self._visits(fresh)).select("unit", "key", "vector", F.lit(True).alias("fresh"), F.lit(False).alias("home"))
        edges = self._first_edges(rows.select("unit", "key", "vector", "fresh", F.lit(True).alias("home")).unionByName(guests)).withColumn("new", F.lit(True))
        if self.edges is not None:
            edges = self.edges.withColumn("new", F.lit(False)).unionByName(edges)
        self.edges = descend(rows.select("key", "vector"), edges, self.intermediate, self.metric, self.rounds, seed=self.seed)
        self.blocks = stage(self._pack(rows, stage(prune(self.edges, self.connectivity))), codec="uncompressed")

        self.enough = self.probes or self._measured(rows)

    def _measured(self, rows: DataFrame) -> int:
        """Nearest lists that hold the share `reach` of the true neighbours of SAMPLE rows."""
        some = rows.orderBy(row_hash(F.col("key"), self.seed + 1), "key").limit(SAMPLE).select("key", "vector").collect()
        y, names = np.frombuffer(b"".join(r["vector"] for r in some), dtype="<f4").reshape(len(some), -1).astype(np.float64), np.array([r["key"] for r in some])
        d = find("l2").quick(y, self.centres)
        place = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1)
        name, k = self.metric, SAMPLE_K + 1

        def run(batches):
            best = Scan(y, k, name)
            lists: dict[int, int] = {}
            for batch in batches:
                keys, of = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                best.add(keys, unpack(batch.column(2)))
                held = np.isin(keys, best.key)
                lists |= dict(zip(keys[held].tolist(), of[held].tolist(), strict=True))
            q, c = np.nonzero(np.isfinite(best.dist))
            keys = best.key[q, c]
            yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(keys), pa.array(best.dist[q, c]), pa.array([lists[i] for i in keys.tolist()], pa.int64())], names=["query_id", "key", "distance", "list"])

        near = top_k(rows.select("key", "list", "vector").mapInArrow(run, "query_id long, key long, distance double, list long"), k).collect()  # SAMPLE x k rows
        number = {int(n): i for i, n in enumerate(names)}
        deep = np.sort([place[number[r["query_id"]], r["list"]] for r in near if r["query_id"] != r["key"]])
        return int(deep[min(len(deep) - 1, int(np.ceil(self.reach * len(deep))))]) + 1 if len(deep) else 1

    # ------------------------------------------------------------ searching

    def _routed(self, queries: DataFrame, probes: int) -> DataFrame:
        """query_id, vector, lists: the nearest centres of each query."""
        centres, probes = self.centres, min(probes, len(self.centres))

        def run(batches):
            for batch in batches:
                near = np.argsort(find("l2").quick(matrix(batch.column(1), False), centres), axis=1, kind="stable")[:, :probes]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, probes, dtype=np.int32)), pa.array(near.ravel().astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["query_id", "vector", "lists"])

        return queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<float>")).mapInArrow(run, "query_id long, vector array<float>, lists array<long>")

    def _at(self, blocks: DataFrame, units: np.ndarray, columns: str) -> DataFrame:
        """Columns of the given blocks; few blocks are looked up by the scan."""
        some = np.unique(units)
        return (blocks.where(F.col("unit").isin(some.tolist())) if len(some) <= 1000 else blocks).select(*columns.split())

    def _step(self, blocks: DataFrame, route: Route, names: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
        """One round: the nearest (allowed) rows of each block that a query enters, and how many distances that took."""
        name, width, keep = self.metric, max(self.expansion_search, k), max(k, FOLLOW)

        def walk(row: dict, bars: np.ndarray) -> list[tuple]:
            unit, n = row["unit"], row["rows"]
            some, place, door = route.at(unit)
            get = lambda c, kind: np.frombuffer(row[c], dtype=kind)
            keys, x = get("keys", np.int64), get("vectors", "<f4").reshape(n, -1).astype(np.float64)
            out, may = [], np.ones(n, dtype=bool)
            if row.get("allowed") is not None:
                may = np.isin(keys, np.array(row["allowed"], dtype=np.int64))
                if not may.any():
                    return []
            few = np.flatnonzero(may)
            for a in range(0, len(some), QUERIES):
                who = some[a : a + QUERIES]
                if n <= SCAN_ROWS or len(few) < THIN * n:
                    found, dist, cost = scan(x[few], vectors[who], name, keep)
                    found = few[found]
                else:
                    on = (door >= 0) & (place >= a) & (place < a + len(who))
                    at, mine = np.searchsorted(keys, door[on]), place[on] - a
                    order = np.argsort(mine, kind="stable")
                    at, mine = at[order], mine[order]
                    nth = np.arange(len(mine)) - np.searchsorted(mine, mine)
                    doors = np.full((len(who), int(nth.max(initial=-1)) + 1), -1)
                    doors[mine, nth] = at
                    found, dist, cost = beam_search(x, get("ends", np.int64), get("links", np.int32), vectors[who], name, width, width, doors)
                    dist = np.where(may[found], dist, np.inf)  # a beam passes through rows that it may not return
                    order = np.argsort(dist, axis=1, kind="stable")[:, :keep]
                    found, dist = np.take_along_axis(found, order, axis=1), np.take_along_axis(dist, order, axis=1)
                # the task has seen rows enough that are nearer than a query's bar
                q, c = np.nonzero(np.isfinite(dist) & (dist <= bars[who][:, None]))
                if dist.shape[1] == keep:
                    bars[who] = np.minimum(bars[who], dist[:, -1])
                out.append((RESULT, names[who[q]], np.full(len(q), unit), keys[found[q, c]], dist[q, c]))
                out.append((COST, names[who], np.full(len(who), unit), cost.astype(np.int64), np.zeros(len(who))))
            return out

        def run(batches):
            bars = np.full(len(names), np.inf)
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                    for kind, *columns in walk(row, bars):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, dtype=np.int32)), *(pa.array(c) for c in columns)], names=["kind", "query", "unit", "key", "dist"])

        columns = "unit rows keys vectors ends links" + " allowed" * ("allowed" in blocks.columns)
        return self._at(blocks, route.unit, columns).mapInArrow(run, STEP)

    def _crossings(self, blocks: DataFrame, best: pa.Table, names: np.ndarray, visited: np.ndarray) -> Route | None:
        """Where the best rows so far (query, unit, key, dist) lead: the `fan` nearest blocks that a query has not entered."""
        query, unit, key, dist = (best.column(c).to_numpy() for c in ("query", "unit", "key", "dist"))
        by_name = np.argsort(names, kind="stable")
        query = by_name[np.searchsorted(names[by_name], query)]
        order = np.argsort(unit, kind="stable")
        unit, key, query, dist = unit[order], key[order], query[order], dist[order]
        visited = np.sort(visited)

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    own, keys, ends, targets, units = (batch.column(j)[i].as_py() for j in range(5))
                    keys, ends, targets, units = (np.frombuffer(c, dtype=np.int64) for c in (keys, ends, targets, units))
                    a, b = np.searchsorted(unit, [own, own + 1])
                    node = np.searchsorted(keys, key[a:b])
                    size = ends[node + 1] - ends[node]
                    last = np.cumsum(size)
                    e = np.arange(last[-1] if len(last) else 0) + np.repeat(ends[node] - last + size, size)
                    q, d, to, target = np.repeat(query[a:b], size), np.repeat(dist[a:b], size), units[e], targets[e]
                    new = ~np.isin(_code(q, to), visited)
                    yield pa.RecordBatch.from_arrays([pa.array(c[new]) for c in (q, to, target, d)], names=["query", "unit", "key", "dist"])

        ways = self._at(blocks, unit, "unit keys cross_ends cross_keys cross_units").mapInArrow(run, "query long, unit long, key long, dist double")
        # how many of the best rows lead to a block says more than how near one of them is
        doors = ways.groupBy("query", "unit").agg(F.count("*").alias("n"), F.min("dist").alias("dist"), F.slice(F.sort_array(F.collect_set("key")), 1, DOORS).alias("doors"))
        w = Window.partitionBy("query").orderBy(F.desc("n"), "dist", "unit")
        some = doors.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= self.fan).select("query", "unit", F.explode("doors").alias("door")).toArrow()  # fan x DOORS a query
        return Route.of(*(some.column(c).to_numpy() for c in ("unit", "query", "door"))) if some.num_rows else None

    def _search_block(self, blocks: DataFrame, rows: pa.Table, k: int) -> DataFrame:
        """STEP rows of all rounds for the queries of one block."""
        names, vectors = rows.column("query_id").to_numpy().astype(np.int64), matrix(rows.column("vector").combine_chunks(), False)
        lists = rows.column("lists").combine_chunks().flatten().to_numpy().reshape(len(names), -1)
        cut = np.array([self.units.get(c, 0) for c in range(len(self.centres))], dtype=np.int64)
        units, who = [], []
        for j in range(ENTER):  # blocks of a list, from one that the query's id names
            q, c = np.nonzero(cut[lists] > j)
            units.append((lists[q, c] << 32) + (names[q] + j) % cut[lists[q, c]])
            who.append(q)
        units, who = np.concatenate(units), np.concatenate(who)
        route, visited, out = Route.of(units, who, np.full(len(who), -1)), _code(who, units), None
        for turn in range(self.hops + 1):
            step = stage(self._step(blocks, route, names, vectors, k))
            out = step if out is None else out.unionByName(step)
            if turn < self.hops:
                results = out.where(F.col("kind") == RESULT)
                nth = F.row_number().over(Window.partitionBy("query").orderBy("dist", "key"))
                best = results.withColumn("nth", nth).where(F.col("nth") <= max(k, FOLLOW)).select("query", "unit", "key", "dist").toArrow()  # so many a query
                route = self._crossings(blocks, best, names, visited)
                if route is None:
                    break
                visited = np.unique(np.append(visited, _code(route.query, route.unit)))
        return out

    def trace(self, queries: DataFrame, k: int, blocks: DataFrame | None = None, probes: int = 0) -> DataFrame:
        """STEP rows of a search: what each block gave, and how many distances it took."""
        out, blocks = None, self.blocks if blocks is None else blocks
        for rows in query_blocks(self._routed(queries, probes or self.probes or self.enough), QUERY_BYTES)[1] if blocks is not None else ():
            if rows.num_rows:
                part = self._search_block(blocks, rows, k)
                out = part if out is None else out.unionByName(part)
        return out if out is not None else queries.sparkSession.createDataFrame([], STEP)

    def search(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """query_id, rank, key, distance. allowed (key): rows that may be found.

        Of few allowed rows (less than THIN of all) each is compared. Else each block carries those of its rows that are allowed, a beam
        passes through the others, and how many lists a query enters is measured on the allowed rows.
        """
        steps = None
        if allowed is not None and self.blocks is not None:
            some = stage(self.rows.join(allowed.select(F.col("key").cast("long").alias("key")).distinct(), "key", "left_semi"))
            if some.count() < THIN * self.rows.count():
                return knn(unpack_vectors(some.select("key", "vector"), "key"), queries, k, self.metric)
            own = some.groupBy("unit").agg(F.collect_list("key").alias("allowed"))  # at most a block's rows
            blocks = stage(self.blocks.join(own, "unit", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<bigint>"))), codec="uncompressed")
            steps = self.trace(queries, k, blocks, self.probes or self._measured(some))
        found = (self.trace(queries, k) if steps is None else steps).where(F.col("kind") == RESULT).select(F.col("query").alias("query_id"), "key", F.col("dist").alias("distance"))
        return top_k(found, k).select("query_id", "rank", "key", "distance")

    # ------------------------------------------------------------ keeping

    def save(self, path: str) -> None:
        for name in ("rows", "edges", "blocks"):
            getattr(self, name).write.parquet(f"{path}/{name}")
        save_meta(self.rows.sparkSession, path, {"kind": "graph", "centres": self.centres.tolist(), "units": [[u, n] for u, n in self.units.items()], **asdict_simple(self)})

    @classmethod
    def loaded(cls, spark: SparkSession, path: str, meta: dict) -> GraphIndex:
        """A saved index as it was: nothing is built anew."""
        centres, units = np.array(meta.pop("centres")), {int(u): n for u, n in meta.pop("units")}
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("rows", "edges", "blocks")}
        return cls(**meta, centres=centres, units=units, **tables)

    def size_bytes(self) -> int:
        if self.blocks is None:
            return 0
        parts = [c.split()[0] for c in BLOCK.split(", ")][2:]
        return self.blocks.agg(F.sum(sum((F.length(c) for c in parts), F.lit(0)))).first()[0] or 0


def _code(query, unit):
    """One number for a query of the block and a graph block."""
    unit = np.asarray(unit, dtype=np.int64)
    return (np.asarray(query, dtype=np.int64) << 40) | ((unit >> 32) << 20) | (unit & 0xFFFFF)
