"""Exact k nearest rows of few coordinates: the leaves of k-d trees, met in two rounds.

A tree per lane is grown on the driver from a sample; a leaf has about ``rows`` donors, or a ``LEAVES``-th
of all.  In the first round a query meets its own leaf, and the k-th distance found there bounds its true
one.  In the second it meets the other leaves that come as near as that, mostly none.  So what a query is
compared with does not grow with the rows up to about 17 million donors of all lanes, and by a ``LEAVES``-th of
them beyond that; the sample never decides a result.

The driver holds at most about ``SAMPLED * LEAVES`` sampled rows and the trees.  A leaf that many queries
ask for is copied to tasks of about ``TASK_QUERIES`` of them.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize, shuffle_partitions

# The functions below travel to the Python workers by value: no copy of the package is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAVES = 16384             # of all lanes, about
SAMPLED = 16               # rows of a leaf in the sample, about
TASK_QUERIES = 16384
SLACK = 1e-9               # bounds are widened by this share, far above the rounding of a distance
PAIRS = 1 << 20            # distances held at once


def distances(rows: np.ndarray, points: np.ndarray, factor: float) -> np.ndarray:
    """[row, point]: the squares are added in the order of the coordinates."""
    total = np.zeros((len(rows), len(points)))
    for j in range(rows.shape[1]):
        gap = rows[:, j, None] - points[None, :, j]
        total += gap * gap
    return np.sqrt(factor * total)


def lanes_of(batch, lane_at: int, x_at: int):
    """(lane, places in the batch, matrix) of each lane in an Arrow batch."""
    lane = batch.column(lane_at).to_numpy(zero_copy_only=False)
    for one in np.unique(lane):
        at = np.flatnonzero(lane == one)
        lists = batch.column(x_at).take(pa.array(at))
        yield int(one), at, lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)


@dataclass
class Tree:
    """Nodes by number, the root first; a leaf is its own child and has a number of its own."""

    dims: np.ndarray
    cuts: np.ndarray
    left: np.ndarray               # rows below the cut
    right: np.ndarray              # rows from the cut on
    leaf: np.ndarray               # -1 at inner nodes

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node, rows = np.zeros(len(x), np.int32), np.arange(len(x))
        while (self.leaf[node] < 0).any():
            node = np.where(x[rows, self.dims[node]] < self.cuts[node], self.left[node], self.right[node])
        return self.leaf[node]

    def within(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of the leaves that may hold a point no farther from a row than its reach."""
        rows, node = np.arange(len(x)), np.zeros(len(x), np.int32)
        found_rows, found = [], []
        while len(rows):
            done = self.leaf[node] >= 0
            found_rows.append(rows[done])
            found.append(self.leaf[node[done]])
            rows, node = rows[~done], node[~done]
            at, cut = x[rows, self.dims[node]], self.cuts[node]
            wide = reach[rows] * (1 + SLACK) + 1e-15 * np.abs(at)
            low, high = ~(at - wide > cut), ~(at + wide < cut)         # a NaN bounds nothing
            rows, node = np.r_[rows[low], rows[high]], np.r_[self.left[node[low]], self.right[node[high]]]
        return np.concatenate(found_rows), np.concatenate(found)


def _cut(points: np.ndarray, least: int):
    """(coordinate, cut) with ``least`` points on either side, in the widest coordinate that has one."""
    spread = points.max(axis=0) - points.min(axis=0)
    for j in np.argsort(-spread, kind="stable"):
        values = np.sort(points[:, j])
        cut = values[len(values) // 2]
        for c in (cut, *values[np.searchsorted(values, cut, "right"):][:1]):
            below = np.searchsorted(values, c, "left")
            if least <= below <= len(values) - least:
                return int(j), float(c)
    return None


def grown(points: np.ndarray, most: float, least: int, first: int) -> Tree:
    """A tree with at most ``most`` of the points in a leaf where they can be parted, ``least`` at any rate; leaves are
    numbered from ``first``."""
    dims, cuts, left, right, leaf = [], [], [], [], []
    count = first
    waits = [(np.arange(len(points)), None, None)]
    while waits:
        at, side, parent = waits.pop()
        number = len(dims)
        if side is not None:
            side[parent] = number
        cut = _cut(points[at], least) if len(at) > most and len(at) >= 2 * least else None
        j, c = cut or (0, 0.0)
        for column, value in ((dims, j), (cuts, c), (left, number), (right, number), (leaf, -1 if cut else count)):
            column.append(value)
        if cut:
            low = points[at, j] < c
            waits += [(at[~low], right, number), (at[low], left, number)]
        else:
            count += 1
    return Tree(np.array(dims), np.array(cuts), *(np.array(c, np.int32) for c in (left, right, leaf)))


def _homed(trees: dict, x_at: int):
    """Rows with the leaf in which they lie."""
    def run(batches):
        for batch in batches:
            block = np.zeros(batch.num_rows, np.int32)
            for lane, at, x in lanes_of(batch, 0, x_at):
                block[at] = trees[lane].home(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], [*batch.schema.names, "block"])
    return run


def _near(trees: dict, factors: dict):
    """(lane, q, x, block, kth) for every leaf but its own (lane, q, x, home, kth) that a query must meet as well."""
    def run(batches):
        for batch in batches:
            home, kth = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            rows, blocks = [np.zeros(0, int)], [np.zeros(0, np.int32)]
            for lane, at, x in lanes_of(batch, 0, 2):
                row, block = trees[lane].within(x, kth[at] / np.sqrt(factors[lane]))
                other = block != home[at][row]
                rows.append(at[row[other]])
                blocks.append(block[other])
            rows, blocks = np.concatenate(rows), np.concatenate(blocks)
            for s in range(0, len(rows), 1 << 16):
                at = pa.array(rows[s:s + (1 << 16)])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(at) for i in range(3)), pa.array(blocks[s:s + (1 << 16)]), batch.column(4).take(at)],
                    ["lane", "q", "x", "block", "kth"])
    return run


def _packed(batches):
    """A leaf (block, key, x, y), sorted by block and key, as a row."""
    def packed(table):
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)

        def whole(name):
            values = table.column(name).combine_chunks()
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        return pa.RecordBatch.from_arrays(
            [table.column("block").slice(0, 1).combine_chunks(), pa.array([len(table)], pa.int64()), pa.array([x.tobytes()], pa.binary()),
             whole("key"), whole("y")], ["block", "donors", "points", "keys", "ys"])

    parts = []                     # of the leaf that the next batch may go on with
    for batch in batches:
        block = batch.column(0).to_numpy(zero_copy_only=False)
        starts = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1] if len(block) else []
        for a, b in zip(starts, [*starts[1:], len(block)]):
            one = pa.Table.from_batches([batch.slice(a, b - a)])
            if parts and parts[0].column(0)[0] != one.column(0)[0]:
                yield packed(pa.concat_tables(parts))
                parts = []
            parts.append(one)
    if parts:
        yield packed(pa.concat_tables(parts))


def _compared(k: int, factors: dict, kinds):
    """(lane, q, x, block, kth, near) of each query for the leaf before it in the partition; ``near`` are its k nearest there
    within ``kth``, and the new ``kth`` is the distance of the last of k."""
    def met(points, keys, ys, batch):
        lane = int(batch["lane"][0].as_py())
        n, dims = len(batch["lane"]), points.shape[1]
        x = batch["x"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dims)
        kth = batch["kth"].to_numpy(zero_copy_only=False)
        d = distances(x, points, factors[lane])
        few = min(k, len(points))
        bound = np.minimum(np.partition(d, few - 1, axis=1)[:, few - 1], kth)
        row, at = np.nonzero(~(d > bound[:, None]) & ~np.isnan(d))
        order = np.lexsort((at, d[row, at], row))                       # equal distances stand by key
        row, at = row[order], at[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, at = row[place < k], at[place < k]
        near = pa.StructArray.from_arrays([keys.take(pa.array(at)).cast(kinds[1]), ys.take(pa.array(at)).cast(kinds[2]), pa.array(d[row, at])],
                                          ["key", "y", "d"])
        counts = np.bincount(row, minlength=n)
        ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
        last = np.full(n, np.inf)
        full = counts == k
        last[full] = d[row, at][ends[1:][full] - 1]
        return pa.RecordBatch.from_arrays(
            [batch["lane"], batch["q"].cast(kinds[0]), batch["x"], batch["block"], pa.array(last), pa.ListArray.from_arrays(pa.array(ends), near)],
            ["lane", "q", "x", "block", "kth", "near"])

    def run(batches):
        points = keys = ys = None
        for batch in batches:
            query, block, salt = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("is_query", "block", "salt"))
            if not len(query):
                continue
            starts = np.r_[0, np.flatnonzero(~query[1:] | ~query[:-1] | (block[1:] != block[:-1]) | (salt[1:] != salt[:-1])) + 1]
            for a, b in zip(starts, [*starts[1:], len(query)]):
                if not query[a]:
                    keys, ys = batch.column("keys")[a].values, batch.column("ys")[a].values
                    points = np.frombuffer(batch.column("points")[a].as_buffer(), np.float64).reshape(len(keys), -1)
                    continue
                step = max(1, PAIRS // len(points))
                for s in range(a, b, step):
                    part = batch.slice(s, min(b, s + step) - s)
                    yield met(points, keys, ys, {n: part.column(n) for n in ("lane", "q", "x", "block", "kth")})
    return run


def _meet(blocks: DataFrame, asked: DataFrame, k: int, factors: dict, kinds: dict) -> DataFrame:
    """``_compared`` of (lane, q, x, block, kth) rows with their blocks."""
    tasks = F.broadcast(asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TASK_QUERIES).alias("tasks")))     # a row a leaf at most
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("lane", "int"), ("q", kinds["q"]), ("x", "array<double>"), ("kth", "double"))}
    leaves = blocks.join(tasks, "block").select(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("salt"), F.lit(False).alias("is_query"),
        "points", "keys", "ys", *none.values())
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("points", "binary"), ("keys", f"array<{kinds['key']}>"), ("ys", f"array<{kinds['y']}>"))]
    rows = asked.join(tasks, "block").select(
        "block", F.pmod(F.xxhash64("q", "x"), F.col("tasks")).alias("salt"), F.lit(True).alias("is_query"), *empty, "lane", "q", "x", "kth")
    together = (leaves.unionByName(rows).repartition(shuffle_partitions(asked.sparkSession), "block", "salt")
                .sortWithinPartitions("block", "salt", "is_query"))
    arrow = [to_arrow_type(t) for t in (asked.schema["q"].dataType, blocks.schema["keys"].dataType.elementType,
                                        blocks.schema["ys"].dataType.elementType)]
    return together.mapInArrow(
        _compared(k, factors, arrow),
        f"lane int, q {kinds['q']}, x array<double>, block int, kth double, near array<struct<key:{kinds['key']},y:{kinds['y']},d:double>>")


def nearest_by_leaves(queries: DataFrame, held: DataFrame, counts: dict[int, int], k: int, factors: dict[int, float],
                      rows: int) -> tuple[DataFrame, DataFrame]:
    """(lane, q, key, y, d) of the k nearest rows, and (block, donors, queries) of what was compared.

    ``queries`` are (lane, q, x) and ``held`` (lane, key, x, y) rows of the lanes of ``counts``, with at most k equal
    donors and no null or NaN in x.
    """
    kinds = {"q": queries.schema["q"].dataType.simpleString(), **{c: held.schema[c].dataType.simpleString() for c in ("key", "y")}}
    most = max(rows / 2, sum(counts.values()) / LEAVES)
    share = min(1.0, SAMPLED / most) if sum(counts.values()) > SAMPLED * rows else 1.0
    some = held if share == 1.0 else held.where(F.pmod(F.xxhash64("x", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    trees, leaves = {}, 0
    sampled = some.select("lane", "x").toArrow().combine_chunks()
    parts = {lane: x for b in sampled.to_batches() for lane, _, x in lanes_of(b, 0, 1)}
    for lane in counts:
        points = parts.get(lane, np.zeros((0, 1)))
        trees[lane] = grown(points, (rows if share == 1.0 else most * share), k, leaves)
        leaves = int(trees[lane].leaf.max()) + 1
    n = shuffle_partitions(held.sparkSession)
    placed = held.mapInArrow(_homed(trees, 2), f"lane int, key {kinds['key']}, x array<double>, y {kinds['y']}, block int")
    blocks = materialize(placed.select("block", "key", "x", "y").repartition(n, "block").sortWithinPartitions("block", "key").mapInArrow(
        _packed, f"block int, donors long, points binary, keys array<{kinds['key']}>, ys array<{kinds['y']}>"))
    homed = materialize(queries.where(F.col("lane").isin(list(counts))).mapInArrow(
        _homed(trees, 2), f"lane int, q {kinds['q']}, x array<double>, block int").withColumn("kth", F.lit(float("inf"))))
    first = materialize(_meet(blocks, homed, k, factors, kinds))
    more = materialize(first.select("lane", "q", "x", "block", "kth").mapInArrow(
        _near(trees, factors), f"lane int, q {kinds['q']}, x array<double>, block int, kth double"))
    near = first.select("lane", "q", "near").unionByName(_meet(blocks, more, k, factors, kinds).select("lane", "q", "near"))
    best = Window.partitionBy("lane", "q").orderBy("d", "key")
    found = (near.select("lane", "q", F.inline("near")).withColumn("at", F.row_number().over(best)).where(F.col("at") <= k).drop("at"))
    met = (homed.select("block").unionByName(more.select("block")).groupBy("block").agg(F.count(F.lit(1)).alias("queries"))
           .join(blocks.select("block", "donors"), "block"))
    return found, met
