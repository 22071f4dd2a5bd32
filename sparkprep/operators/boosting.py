"""Gradient-boosted trees from distributed gradient histograms, for any number of classes.

Every round grows one tree a class (one in all for two classes or a number).  A level of all
those trees is one pass: the tasks bin the gradients of their rows by (tree, node, feature, bin),
the sums meet in Spark (small ones on the driver), the best split of each node is chosen for a class
and a group of features, and the driver receives those.  Second-order gains and leaf values with an L2 penalty,
as the well-known boosting libraries define them.

Features are cut once at quantiles of a bounded sample, which only limits where a split can lie;
all statistics cover all rows.  Rows hold their scores, refreshed from the trees every
``REFRESH`` rounds by one narrow pass over the checkpointed blocks.

Rows of equal cells have equal scores, so their gradients are known from how many there are of each class, or
their sum.  Where the cells are few (``CELL_VALUES``, at most so many scores) the rows are counted by cell once,
and one task grows all trees from that table by the same rules: no pass over the rows a level.
"""

from __future__ import annotations

import math
import pickle
import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from .blocks import feature_blocks

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 256                # a feature's cells: a byte each
SAMPLE_ROWS = 20_000      # rows that the cut points are taken from, about
REFRESH = 10
SLOT_VALUES = 1 << 17     # histogram entries of a slot (a class and a group of features), about
PASS_VALUES = 1 << 23     # histogram entries a task holds at a time (64 MB)
CELL_VALUES = 1 << 20     # scores (cells by classes) of a table that one task holds
DRIVER_VALUES = 1 << 21   # histogram entries of all tasks that may meet on the driver (16 MB); more meet by a shuffle


@dataclass(frozen=True)
class Settings:
    rounds: int = 100
    depth: int = 6
    rate: float = 0.3
    penalty: float = 1.0          # L2 on leaf values
    least_weight: float = 1.0     # second derivatives that a child holds at least
    least_gain: float = 1e-6


@dataclass
class Tree:
    """A complete binary tree: node i has the children 2i and 2i + 1; feature -1 makes a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> "Tree":
        n = 1 << (depth + 1)
        return Tree(np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n))

    def places(self, cells: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row after ``depth`` levels."""
        flat, rows = cells.reshape(-1), np.arange(len(cells)) * cells.shape[1]
        node = np.ones(len(cells), np.int64)
        for _ in range(depth):
            feature = self.feature[node]
            node = np.where(feature >= 0, 2 * node + (flat.take(rows + feature) > self.cut[node]), node)
        return node


def to_cells(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Per value the number of its feature's cut points below it; a missing value is above all."""
    return np.stack([np.searchsorted(e, x[:, j], side="left").astype(np.uint8) for j, e in enumerate(edges)], axis=1)


def raw_scores(cells: np.ndarray, start: np.ndarray, rounds: list, depth: int) -> np.ndarray:
    out = np.tile(start, (len(cells), 1))
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += tree.value[tree.places(cells, depth)]
    return out


def gradients(kind: str, score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by each score."""
    if kind == "squared":
        return score - y[:, None], np.ones_like(score)
    if kind == "logistic":
        p = 1 / (1 + np.exp(-score))
        return p - y[:, None], np.maximum(p * (1 - p), 1e-16)
    p = probabilities(kind, score)
    return p - (np.arange(score.shape[1]) == y[:, None]), np.maximum(2 * p * (1 - p), 1e-16)


def probabilities(kind: str, score: np.ndarray) -> np.ndarray:
    if kind == "logistic":
        p = 1 / (1 + np.exp(-score[:, 0]))
        return np.stack([1 - p, p], axis=1)
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def best_split(hist: np.ndarray, s: Settings) -> np.ndarray:
    """(gain, feature, cut, g left, h left, g, h) of a node's histogram [feature, cell, (g, h)]; of equal
    gains the first feature and cut; gain 0 where no split is allowed."""
    left = hist.cumsum(axis=1)
    g, h = left[0, -1]
    gl, hl = left[:, :-1, 0], left[:, :-1, 1]
    gr, hr = g - gl, h - hl

    def part(a, b):
        return a * a / (b + s.penalty)

    gain = part(gl, hl) + part(gr, hr) - part(g, h)
    gain = np.where((hl >= s.least_weight) & (hr >= s.least_weight), gain, 0.0)
    at = int(gain.argmax())
    feature, cut = divmod(at, gain.shape[1])
    found = gain[feature, cut]
    return np.array([found if found > s.least_gain else 0.0, feature, cut, gl[feature, cut], hl[feature, cut], g, h])


def _level(width, kind, recent, trees, level, depth, bins, units):
    """Histograms [node, feature, cell, (g, h)] of the open nodes of a level, added up over the task's
    blocks, for ``units`` of (slot, class, first feature, last feature)."""
    def run(blocks):
        first = 1 << level
        total = {slot: np.zeros((first, b - a, bins, 2)) for slot, _, a, b in units}
        for n, x, y, f in blocks:
            cells = np.frombuffer(x, np.uint8).reshape(n, width)
            score = np.frombuffer(f, np.float64).reshape(n, len(trees))
            score = score + raw_scores(cells, np.zeros(len(trees)), recent, depth)
            g, h = gradients(kind, score, np.frombuffer(y, np.float64))
            nodes = {}
            for slot, c, a, b in units:
                if c not in nodes:
                    node = trees[c].places(cells, level) - first
                    here = np.flatnonzero(node >= 0)        # rows that rest in a leaf above are done
                    nodes[c] = here, node[here] * bins, g[here, c], h[here, c]
                here, base, g_here, h_here = nodes[c]
                for j in range(a, b):
                    cell = base + cells[here, j]
                    total[slot][:, j - a, :, 0] += np.bincount(cell, g_here, first * bins).reshape(first, bins)
                    total[slot][:, j - a, :, 1] += np.bincount(cell, h_here, first * bins).reshape(first, bins)
        yield from total.items()
    return run


def _passes(k: int, width: int, first: int, bins: int) -> list[list[tuple[int, int, int, int]]]:
    """Units (slot, class, first feature, last feature) of a level, in passes that fit a task's memory."""
    one = first * bins * 2
    group = max(1, min(width, SLOT_VALUES // one))
    units = [(c, a, min(width, a + group)) for c in range(k) for a in range(0, width, group)]
    most = max(1, PASS_VALUES // (one * group))
    numbered = [(i, *u) for i, u in enumerate(units)]
    return [numbered[i:i + most] for i in range(0, len(numbered), most)]


def _splits(settings):
    def finish(hist):
        return np.stack([best_split(node, settings) for node in hist])
    return finish


def _scored(width, start, rounds, depth):
    """Blocks (n, x, y, f) with the scores f of all ``rounds`` so far."""
    def run(rows):
        for n, x, y, _ in rows:
            f = raw_scores(np.frombuffer(x, np.uint8).reshape(n, width), start, rounds, depth)
            yield n, bytes(x), bytes(y), f.tobytes()
    return run


def _level_splits(held, level, finish, tasks: int, slots: int, values: int) -> dict[int, np.ndarray]:
    """slot -> best splits of its nodes, from histograms of ``values`` entries a task.

    A level is a small job and there are hundreds of them, so it is a plain RDD job, without a plan to make.
    Histograms meet in Spark, where the splits are chosen, and the driver receives a row a node; only those that
    take DRIVER_VALUES entries at most over all tasks are sent there, which saves each job its second stage.
    """
    parts = held.mapPartitions(level)
    if tasks == 1:
        return dict(parts.mapValues(finish).collect())
    if tasks * values > DRIVER_VALUES:
        return dict(parts.reduceByKey(np.add, max(1, min(tasks, slots))).mapValues(finish).collect())
    total: dict = {}
    for slot, hist in parts.collect():
        total[slot] = total[slot] + hist if slot in total else hist
    return {slot: finish(hist) for slot, hist in total.items()}


def _branch(trees: list, open_nodes: set, best: dict, s: Settings) -> set:
    """Splits the open (class, node)s by their rows of ``best``; the nodes that this opens."""
    following = set()
    for c, node in sorted(open_nodes):
        gain, feature, cut, gl, hl, g, h = best[c, node]
        tree = trees[c]
        tree.value[node] = -s.rate * g / (h + s.penalty)
        if gain > 0:
            tree.feature[node], tree.cut[node], tree.gain[node] = -int(feature), int(cut), gain
            tree.value[2 * node] = -s.rate * gl / (hl + s.penalty)
            tree.value[2 * node + 1] = -s.rate * (g - gl) / (h - hl + s.penalty)
            following |= {(c, 2 * node), (c, 2 * node + 1)}
    return following


def counted_gradients(kind: str, score: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``gradients`` added up over the n rows of each cell; ``y`` has the rows by class, or the sum of the labels."""
    if kind == "squared":
        return n[:, None] * score - y, np.repeat(n[:, None], score.shape[1], axis=1)
    p = probabilities(kind, score)
    if kind == "logistic":
        p, y = p[:, 1:], y[:, 1:]
        return n[:, None] * p - y, n[:, None] * np.maximum(p * (1 - p), 1e-16)
    return n[:, None] * p - y, n[:, None] * np.maximum(2 * p * (1 - p), 1e-16)


def boosted(cells: np.ndarray, n: np.ndarray, y: np.ndarray, kind: str, start: np.ndarray, bins: int, s: Settings) -> list:
    """All rounds of trees from counted cells."""
    width, rounds, score = cells.shape[1], [], np.tile(start, (len(cells), 1))
    columns, flat, rows = [cells[:, j].astype(np.int64) for j in range(width)], cells.reshape(-1), np.arange(len(cells)) * width
    for _ in range(s.rounds):
        g, h = (np.ascontiguousarray(v.T) for v in counted_gradients(kind, score, n, y))
        trees = [Tree.empty(s.depth) for _ in start]
        for c, tree in enumerate(trees):
            node, open_nodes = np.ones(len(cells), np.int64), {(c, 1)}
            for level in range(s.depth):
                first = 1 << level
                on = node >= first                                  # cells that rest in a leaf above are done
                whole = on.all()
                base, g_here, h_here = (v if whole else v[on] for v in ((node - first) * bins, g[c], h[c]))
                hist = np.zeros((first, width, bins, 2))
                for j, column in enumerate(columns):
                    cell = base + (column if whole else column[on])
                    hist[:, j, :, 0] = np.bincount(cell, g_here, first * bins).reshape(first, bins)
                    hist[:, j, :, 1] = np.bincount(cell, h_here, first * bins).reshape(first, bins)
                found = {(c, i): best_split(hist[i - first], s) for _, i in open_nodes}
                open_nodes = _branch(trees, open_nodes, {at: (v[0], -v[1], *v[2:]) for at, v in found.items()}, s)
                if not open_nodes:
                    break
                feature = tree.feature.take(node)
                below = 2 * node + (flat.take(rows + feature) > tree.cut.take(node))
                node = np.where(feature >= 0, below, node)
            score[:, c] += tree.value.take(node)
        rounds.append(trees)
    return rounds


def codes_of(cells: np.ndarray, sizes: list[int]) -> np.ndarray:
    """A number for each row of cells; feature j has ``sizes[j]`` cells."""
    code = np.zeros(len(cells), np.int64)
    for j, n in enumerate(sizes):
        code = code * n + cells[:, j]
    return code


def cells_of(codes: np.ndarray, sizes: list[int]) -> np.ndarray:
    out = np.empty((len(codes), len(sizes)), np.int64)
    for j in range(len(sizes) - 1, -1, -1):
        codes, out[:, j] = np.divmod(codes, sizes[j])
    return out


def _coded(edges, sizes):
    """(code, y) of rows (x, y)."""
    def run(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(sizes))
            yield pa.RecordBatch.from_arrays([pa.array(codes_of(to_cells(x, edges), sizes)), batch.column(1)], ["code", "y"])
    return run


def _table_rounds(sizes, classes, kind, start, bins, s):
    """The rounds, pickled, from the table (code, y, n): rows of a cell and class, or of a cell with the sum of its labels."""
    def run(batches):
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        code, y, n = (np.concatenate(c) for c in zip(*held))
        found, at = np.unique(code, return_inverse=True)
        total = np.bincount(at, n, len(found))
        if classes is None:
            by = np.bincount(at, y, len(found))[:, None]
        else:
            by = np.bincount(at * classes + y.astype(np.int64), n, len(found) * classes).reshape(-1, classes)
        rounds = boosted(cells_of(found, sizes).astype(np.uint8), total, by, kind, start, bins, s)
        payload = pickle.dumps([[(t.feature, t.cut, t.value, t.gain) for t in trees] for trees in rounds])
        yield pa.RecordBatch.from_arrays([pa.array([payload], pa.binary())], ["payload"])
    return run


def _rounds_by_cells(df, features, label, classes, edges, kind, start, bins, s) -> list | None:
    """The rounds where the rows have few cells, or None."""
    sizes = [len(e) + 1 for e in edges]
    if math.prod(sizes) >= 1 << 62:
        return None
    coded = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")).mapInArrow(
        _coded(edges, sizes), "code long, y double")
    if coded.agg(F.approx_count_distinct("code")).first()[0] * len(start) > CELL_VALUES:
        return None
    one = F.count(F.lit(1)).cast("double").alias("n")
    table = (coded.groupBy("code").agg(F.sum("y").alias("y"), one) if classes is None else coded.groupBy("code", "y").agg(one))
    grown = table.select("code", "y", "n").repartition(1).mapInArrow(_table_rounds(sizes, classes, kind, start, bins, s), "payload binary")
    return [[Tree(*parts) for parts in trees] for trees in pickle.loads(grown.first()["payload"])]


@dataclass
class BoostedModel:
    kind: str                     # "softmax" | "logistic" | "squared"
    edges: list
    start: np.ndarray
    depth: int
    rounds: list = field(default_factory=list)

    def apply(self, df: DataFrame, features: str) -> DataFrame:
        """Adds ``prediction``, and ``probs`` for classes."""
        kind, edges, start, depth, rounds = self.kind, self.edges, self.start, self.depth, self.rounds

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def scored(x):
            import pandas as pd
            if not len(x):
                return pd.Series([], dtype=object)
            score = raw_scores(to_cells(np.stack(x.to_numpy()), edges), start, rounds, depth)
            return pd.Series(list(score if kind == "squared" else probabilities(kind, score)))

        out = df.withColumn("probs", scored(vector_to_array(features)))
        if kind == "squared":
            return out.withColumn("prediction", F.col("probs")[0]).drop("probs")
        return out.withColumn("prediction", most_likely(F.col("probs")))

    @property
    def featureImportances(self):
        """Mean gain of a feature's splits, as shares."""
        from pyspark.ml.linalg import Vectors
        gain, count = np.zeros(len(self.edges)), np.zeros(len(self.edges))
        for trees in self.rounds:
            for t in trees:
                used = t.feature >= 0
                np.add.at(gain, t.feature[used], t.gain[used])
                np.add.at(count, t.feature[used], 1)
        mean = gain / np.maximum(count, 1)
        return Vectors.dense(mean / mean.sum() if mean.sum() else mean)


def most_likely(probs: Column) -> Column:
    """Index of the largest entry, the first of equal ones, as a double."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("double")


def cut_points(df: DataFrame, features: str, width: int, rows: int, bins: int = BINS) -> list[np.ndarray]:
    """Per feature up to ``bins - 1`` cut points: middles between neighbouring values or quantiles of a sample.

    The sample is taken by the hash of the features, about SAMPLE_ROWS rows at any size.
    """
    x = vector_to_array(features)
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    some = df.select(x.alias("x"))
    if share < 1:
        some = some.where(F.pmod(F.xxhash64("x"), F.lit(1_000_000)) < F.lit(max(1, int(share * 1_000_000))))
    held = np.array([r["x"] for r in some.limit(4 * SAMPLE_ROWS).collect()]).reshape(-1, width)
    edges = []
    for j in range(width):
        values = np.unique(held[:, j][~np.isnan(held[:, j])])
        if len(values) > bins:
            values = np.unique(np.quantile(held[:, j], np.linspace(0, 1, bins), method="nearest"))
        edges.append((values[1:] + values[:-1]) / 2)
    return edges


def fit(df: DataFrame, features: str, label: str, classes: int | None, width: int, rows: int,
        settings: Settings = Settings()) -> BoostedModel:
    """Boosted trees on ``df``: ``classes`` of labels 0, 1, ..., or None for a number."""
    s = settings
    kind = "squared" if classes is None else "logistic" if classes == 2 else "softmax"
    k = 1 if kind != "softmax" else classes
    edges = cut_points(df, features, width, rows)
    bins = max(2, max((len(e) for e in edges), default=1) + 1)
    start = np.zeros(k)
    if kind == "squared":
        start[0] = df.agg(F.avg(label)).first()[0] or 0.0
    model = BoostedModel(kind, edges, start, s.depth)
    few = _rounds_by_cells(df, features, label, classes, edges, kind, start, bins, s)
    if few is not None:
        model.rounds = few
        return model
    blocks, _ = feature_blocks(df, features, label, width, rows, prepare=lambda x: to_cells(x, edges))
    held, since = None, 0
    for r in range(s.rounds):
        if r % REFRESH == 0:
            fresh = blocks.rdd.mapPartitions(_scored(width, start, model.rounds, s.depth)).persist(StorageLevel.MEMORY_AND_DISK)
            parts = fresh.getNumPartitions()
            if held is not None:
                held.unpersist()
            held, since = fresh, r
        trees = [Tree.empty(s.depth) for _ in range(k)]
        open_nodes = {(c, 1) for c in range(k)}
        for level in range(s.depth):
            first, best = 1 << level, {}
            for units in _passes(k, width, first, bins):
                task = _level(width, kind, model.rounds[since:], trees, level, s.depth, bins, units)
                of_slot = {slot: (c, a) for slot, c, a, _ in units}
                values = sum(b - a for *_, a, b in units) * first * bins * 2
                for slot, v in _level_splits(held, task, _splits(s), parts, len(units), values).items():
                    c, a = of_slot[slot]
                    for node, row in enumerate(v, first):
                        row = (row[0], -(a + row[1]), *row[2:])            # of equal gains the first feature
                        best[c, node] = max(best.get((c, node), row), row)
            open_nodes = _branch(trees, open_nodes, best, s)
            if not open_nodes:
                break
        model.rounds.append(trees)
    held.unpersist()
    return model
