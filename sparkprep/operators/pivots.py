"""Exact k nearest rows by pivots: Voronoi cells and the triangle inequality.

Rows to be searched (donors) go to the nearest of a bounded number of pivots, and each cell is cut
by distance from its pivot into blocks of ``BLOCK_ROWS``.  A query's distances to the pivots bound
its k-th distance from above (the k smallest radii of every cell are known) and every cell's and
block's distances from below, so it is compared with the blocks that can hold one of its k nearest
and with no other.  Queries travel in chunks of ``CHUNK_ROWS`` that share their visits.

Nothing is a task's or the driver's alone: of equal donors only the k first by key are kept (map-side),
a crowded cell is many blocks, a block that many chunks visit is copied to up to ``SALTS`` tasks, and
the driver holds the pivots and their cells, whose number does not grow with the rows.

With the number of pivots bounded, a cell grows with the rows, and so do the rows that a query meets.  So
lanes of at most ``TREE_DIMS`` coordinates go by k-d trees instead (``kdtree``), whose leaves do not grow.

Searches of several kinds run together as lanes; a row only meets rows of its lane.  The distance is
sqrt(factor * sum of squared differences) with the lane's factor.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize, shuffle_partitions
from .kdtree import SLACK, distances, lanes_of, nearest_by_leaves

# The functions below travel to the Python workers by value: no copy of the package is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIVOTS = 256               # of a lane at most; about the square root of its rows below that
BLOCK_ROWS = 2048
CHUNK_ROWS = 256
SALTS = 64
TREE_DIMS = 4              # lanes of at most so many coordinates go by the leaves of a k-d tree


@dataclass
class Cells:
    """The pivots of a lane with the radii of their cells."""

    factor: float
    pivots: np.ndarray                 # cells x dimensions
    low: np.ndarray                    # smallest and largest distance of a member from its pivot
    high: np.ndarray
    nearest: np.ndarray                # the k smallest such distances, infinite where there are fewer
    between: np.ndarray                # distances of the pivots from one another


def _placed(pivots: dict, factors: dict, x_at: int):
    """Rows with the nearest pivot of their lane and the distance from it."""
    def run(batches):
        for batch in batches:
            cell, r = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for lane, at, x in lanes_of(batch, 0, x_at):
                d = distances(x, pivots[lane], factors[lane])
                cell[at], r[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(r)], [*batch.schema.names, "cell", "r"])
    return run


def _packed(batches):
    """Blocks of rows (lane, key, x, y, cell, r) sorted by lane, cell and r; a block's rows stand by key."""
    part, number, held = TaskContext.get().partitionId(), 0, None

    def block(table):
        nonlocal number
        table = table.combine_chunks()
        keys = table.column("key").to_pylist()
        order = pa.array(sorted(range(len(keys)), key=keys.__getitem__))
        table = table.take(order)
        r = table.column("r").to_numpy()
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)

        def whole(name):
            values = table.column(name).combine_chunks()
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        number += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([part << 32 | number]), table.column("lane").slice(0, 1).combine_chunks(),
             table.column("cell").slice(0, 1).combine_chunks(), pa.array([r.min()]), pa.array([r.max()]),
             pa.array([len(keys)], pa.int64()), pa.array([x.tobytes()], pa.binary()), whole("key"), whole("y")],
            ["block", "lane", "cell", "low", "high", "n", "x", "keys", "ys"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        lane, cell = (held.column(n).to_numpy() for n in ("lane", "cell"))
        cuts = np.flatnonzero(np.r_[True, (lane[1:] != lane[:-1]) | (cell[1:] != cell[:-1])]) if len(lane) else np.zeros(0, int)
        done = 0
        for a, b in zip(cuts, np.r_[cuts[1:], len(lane)]):
            last = b == len(lane)
            for s in range(a, b, BLOCK_ROWS):
                e = min(b, s + BLOCK_ROWS)
                if last and e == b:            # its cell may go on in the next batch
                    break
                yield block(held.slice(s, e - s))
                done = e
        held = held.slice(done)
    if held is not None and len(held):
        yield block(held)


def bounds(cells: Cells, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every query its distance to the pivots, an upper bound of its k-th distance, and whether a cell may hold one
    of its k nearest."""
    to_pivots = distances(x, cells.pivots, cells.factor)
    k = cells.nearest.shape[1]
    ways = (to_pivots[:, :, None] + cells.nearest[None]).reshape(len(x), -1)
    kth = np.partition(ways, k - 1, axis=1)[:, k - 1] * (1 + SLACK)
    own = to_pivots.argmin(axis=1)
    nearest = to_pivots[np.arange(len(x)), own]
    # a member of another cell lies beyond the plane halfway between its pivot and the query's own
    gap = cells.between[own]
    beyond = np.divide(to_pivots ** 2 - nearest[:, None] ** 2, 2 * gap, out=np.zeros_like(gap), where=gap > 0)
    least = np.maximum(np.maximum(to_pivots - cells.high, cells.low - to_pivots), beyond)
    limit = kth[:, None] + SLACK * to_pivots
    return to_pivots, kth, (least <= limit) & np.isfinite(cells.low)


def _chunks(cells: dict):
    """Chunks of queries (lane, cell, q, x), sorted by lane and cell, with the cells they visit and the range of radii
    in each.  The queries of a chunk have one nearest pivot, so they visit much the same."""
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            lanes, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(lanes):
                continue
            cuts = np.flatnonzero(np.r_[True, (lanes[1:] != lanes[:-1]) | (own[1:] != own[:-1])])
            runs = [(s, min(b, s + CHUNK_ROWS)) for a, b in zip(cuts, np.r_[cuts[1:], len(lanes)]) for s in range(a, b, CHUNK_ROWS)]
            for a, b in runs:
                lane, n = int(lanes[a]), b - a
                x = batch.column(3).slice(a, n).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
                to_pivots, kth, visit = bounds(cells[lane], x)
                wide = kth[:, None] + SLACK * to_pivots
                low = np.where(visit, to_pivots - wide, np.inf).min(axis=0)
                high = np.where(visit, to_pivots + wide, -np.inf).max(axis=0)
                seen = np.flatnonzero(visit.any(axis=0))
                number += 1
                one = pa.array([0, n], pa.int32())
                visits = pa.StructArray.from_arrays(
                    [pa.array(seen.astype(np.int32)), pa.array(low[seen]), pa.array(high[seen])], ["cell", "low", "high"])
                q = pa.concat_arrays([batch.column(2).slice(a, n)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part << 32 | number]), pa.array([lane], pa.int32()), pa.array([x.tobytes()], pa.binary()),
                     pa.ListArray.from_arrays(one, q), pa.ListArray.from_arrays(one, pa.array(kth)),
                     pa.ListArray.from_arrays(pa.array([0, len(seen)], pa.int32()), visits)],
                    ["chunk", "lane", "x", "qs", "kth", "visits"])
    return run


def _compared(k: int, factors: dict, kinds):
    """The k nearest of each block for each query of the chunks that follow it in the partition."""
    names = ["lane", "q", "key", "y", "d"]

    def run(batches):
        donors = keys = ys = None
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                raw = columns["x"][i].as_buffer()
                if not columns["is_query"][i].as_py():
                    keys, ys = columns["keys"][i].values, columns["ys"][i].values
                    donors = np.frombuffer(raw, np.float64).reshape(len(keys), -1)
                    continue
                lane, qs, kth = columns["lane"][i].as_py(), columns["qs"][i].values, columns["kth"][i].values.to_numpy()
                found_q, found_at, found_d = [], [], []
                apart = distances(np.frombuffer(raw, np.float64).reshape(len(qs), -1), donors, factors[lane])
                for j, d in enumerate(apart):
                    near = np.flatnonzero(d <= kth[j])
                    near = near[np.argsort(d[near], kind="stable")[:k]]        # equal distances stand by key
                    found_q.append(np.full(len(near), j))
                    found_at.append(near)
                    found_d.append(d[near])
                at, q = pa.array(np.concatenate(found_at)), pa.array(np.concatenate(found_q))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), lane, np.int32)), qs.take(q).cast(kinds[0]), keys.take(at).cast(kinds[1]),
                     ys.take(at).cast(kinds[2]), pa.array(np.concatenate(found_d))], names)
    return run


@dataclass
class NearestRows:
    """``rows``: (lane, q, key, y, d), the k nearest of each query; ``met``: what was compared, the rows
    ``donors`` of a block with the rows ``queries``."""

    rows: DataFrame
    met: DataFrame | None

    def pairs_compared(self) -> int:
        if self.met is None:
            return 0
        return self.met.agg(F.sum(F.col("donors") * F.col("queries"))).first()[0] or 0


def nearest(queries: DataFrame, donors: DataFrame, k: int, factors: dict[int, float] | None = None) -> NearestRows:
    """The k nearest ``(lane, key, x, y)`` rows of each ``(lane, q, x)`` row; equal distances go to the smaller key.

    x is array<double> of one length in a lane.  Rows whose x is null or holds a null or NaN take no
    part; fewer than k donors are all returned; a lane without donors gives its queries no rows.
    """
    spark = donors.sparkSession
    whole = F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))
    donors = donors.where(whole).select(F.col("lane").cast("int").alias("lane"), "key", "x", "y")
    queries = queries.where(whole).select(F.col("lane").cast("int").alias("lane"), "q", "x")
    same = Window.partitionBy("lane", "x").orderBy("key")
    held = materialize(donors.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k))
    sizes = held.groupBy("lane").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dims")).collect()
    factors = {r["lane"]: (factors or {}).get(r["lane"], 1.0) for r in sizes}
    flat = {r["lane"]: r["n"] for r in sizes if 0 < r["dims"] <= TREE_DIMS}
    deep = {r["lane"]: r["n"] for r in sizes if r["lane"] not in flat}
    if not sizes:
        kinds = ", ".join(f"{n} {held.schema[n].dataType.simpleString()}" for n in ("key", "y"))
        return NearestRows(spark.createDataFrame([], f"lane int, q {queries.schema['q'].dataType.simpleString()}, {kinds}, d double"), None)
    found = []
    if flat:
        found.append(nearest_by_leaves(queries, held.where(F.col("lane").isin(list(flat))).drop("copy"), flat, k, factors, BLOCK_ROWS))
    if deep:
        found.append(_nearest_by_pivots(queries, held.where(F.col("lane").isin(list(deep))), deep, k, factors))
    rows, met = found[0]
    for more, others in found[1:]:
        rows, met = rows.unionByName(more), met.select("donors", "queries").unionByName(others.select("donors", "queries"))
    return NearestRows(rows, met)


def _nearest_by_pivots(queries: DataFrame, held: DataFrame, counts: dict[int, int], k: int,
                       factors: dict[int, float]) -> tuple[DataFrame, DataFrame]:
    spark = held.sparkSession
    kinds = [f"{n} {held.schema[n].dataType.simpleString()}" for n in ("key", "y")]
    q_kind = queries.schema["q"].dataType
    out_kind = f"lane int, q {q_kind.simpleString()}, {', '.join(kinds)}, d double"
    by_hash = Window.partitionBy("lane").orderBy(F.xxhash64("x", F.lit(7)), "x")
    points: dict[int, list] = {}
    for r in (held.where("copy = 1").withColumn("at", F.row_number().over(by_hash)).where(F.col("at") <= PIVOTS)
              .select("lane", "at", "x").orderBy("lane", "at").collect()):       # PIVOTS rows a lane
        if r["at"] <= max(1, math.isqrt(counts[r["lane"]])):
            points.setdefault(r["lane"], []).append(r["x"])
    pivots = {lane: np.array(x, float).reshape(len(x), -1) for lane, x in points.items()}
    placed = materialize(held.drop("copy").mapInArrow(
        _placed(pivots, factors, 2), f"lane int, {kinds[0]}, x array<double>, {kinds[1]}, cell int, r double"))
    ranked = Window.partitionBy("lane", "cell").orderBy("r")
    smallest = (placed.select("lane", "cell", "r").withColumn("at", F.row_number().over(ranked)).where(F.col("at") <= k)
                .groupBy("lane", "cell").agg(F.sort_array(F.collect_list("r")).alias("rs")))
    extent = placed.groupBy("lane", "cell").agg(F.min("r").alias("low"), F.max("r").alias("high"))
    cells = {lane: Cells(factors[lane], p, np.full(len(p), np.inf), np.full(len(p), -np.inf), np.full((len(p), k), np.inf),
                         distances(p, p, factors[lane])) for lane, p in pivots.items()}
    for r in extent.join(smallest, ["lane", "cell"]).collect():                  # a row a cell
        c = cells[r["lane"]]
        c.low[r["cell"]], c.high[r["cell"]] = r["low"], r["high"]
        c.nearest[r["cell"], :len(r["rs"])] = r["rs"]
    n = shuffle_partitions(spark)
    order = ["lane", "cell", "r", "key"]
    types = [held.schema[c].dataType.simpleString() for c in ("key", "y")]
    blocks = materialize(placed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        _packed, f"block long, lane int, cell int, low double, high double, n long, x binary, keys array<{types[0]}>, ys array<{types[1]}>"))
    near = (queries.where(F.col("lane").isin(list(counts)))
            .mapInArrow(_placed(pivots, factors, 2), f"lane int, q {q_kind.simpleString()}, x array<double>, cell int, r double")
            .repartitionByRange(n, "lane", "cell", "r", "q").sortWithinPartitions("lane", "cell", "r"))
    chunks = materialize(near.select("lane", "cell", "q", "x").mapInArrow(
        _chunks(cells), f"chunk long, lane int, x binary, qs array<{q_kind.simpleString()}>, kth array<double>, "
                        "visits array<struct<cell:int,low:double,high:double>>"))
    visits = (chunks.select("chunk", "lane", F.size("qs").alias("queries"), F.explode("visits").alias("v"))
              .select("chunk", "lane", "queries", "v.cell", F.col("v.low").alias("from"), F.col("v.high").alias("to"),
                      F.pmod(F.xxhash64("chunk"), F.lit(16)).alias("part")))
    # the directory of blocks, a row for BLOCK_ROWS donors, is copied so that a crowded cell is many join keys
    directory = blocks.select("block", "lane", "cell", "low", "high", F.col("n").alias("donors"),
                              F.explode(F.expr("sequence(0L, 15L)")).alias("part"))
    met = materialize(visits.join(directory, ["lane", "cell", "part"]).where("low <= to AND high >= from")
                      .select("block", "chunk", "donors", "queries", F.pmod(F.xxhash64("chunk"), F.lit(SALTS)).alias("salt")))
    asked = met.select("block", "salt").distinct()
    sides = (blocks.join(asked, "block").select(
        "block", "salt", F.lit(False).alias("is_query"), "lane", "x", "keys", "ys",
        F.lit(None).cast(f"array<{q_kind.simpleString()}>").alias("qs"), F.lit(None).cast("array<double>").alias("kth"))
        .unionByName(met.select("block", "salt", "chunk").join(chunks.drop("visits"), "chunk").select(
            "block", "salt", F.lit(True).alias("is_query"), "lane", "x", F.lit(None).cast(f"array<{types[0]}>").alias("keys"),
            F.lit(None).cast(f"array<{types[1]}>").alias("ys"), "qs", "kth")))
    together = sides.repartition(n, "block", "salt").sortWithinPartitions("block", "salt", "is_query")
    arrow = [to_arrow_type(t) for t in (q_kind, held.schema["key"].dataType, held.schema["y"].dataType)]
    found = together.select("is_query", "lane", "x", "keys", "ys", "qs", "kth").mapInArrow(_compared(k, factors, arrow), out_kind)
    best = Window.partitionBy("lane", "q").orderBy("d", "key")
    return found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k).drop("at"), met
