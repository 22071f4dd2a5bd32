"""Random forests grown from counted cells, for training rows that share few of them.

Features are cut at quantiles into at most ``BINS`` cells, as in MLlib's forests, so rows of equal cells are
alike to a tree but for their label.  A row's weight in each tree's bootstrap sample is drawn from the hash of
its key: Poisson with mean one, the same in any order and partitioning.  One pass adds up, for every tree and
cell, the weights by class (or the weight, sum and sum of squares of a number); rows are dealt out by
(cell, hash), so a cell of any size is spread.  Then each tree is grown by one task from its cells: Gini
impurity or variance, a random choice of features a node, the leaves of equal predictions joined.

A tree's table has a row a cell, at most ``CELLS``, whatever the number of rows.  ``fit`` gives None where
there are more cells, or fewer than ``ROWS_A_CELL`` rows a cell: there MLlib's forest is grown over the rows.
"""

from __future__ import annotations

import math
import pickle
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, shuffle_partitions
from .blocks import TASK_ROWS
from .boosting import Tree, cells_of, codes_of, cut_points, most_likely, to_cells

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
CELLS = 1 << 20
ROWS_A_CELL = 8
BAG_ROWS = 500_000        # rows of a task that adds up the bootstrap samples, about
DRAWS = 4                 # trees that one hash serves, sixteen bits each
KNOWN = 1 << 18           # cells of which a task remembers the scores


@dataclass(frozen=True)
class Settings:
    trees: int = 100
    depth: int = 12
    subset: int | None = None     # features tried at a node; None: all
    seed: int = 42


def _poisson() -> np.ndarray:
    """The weight for each value of sixteen random bits."""
    ends = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])
    return np.searchsorted(ends, (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(np.uint8)


POISSON = _poisson()


def draws(hashes: np.ndarray, number: int, seed: int) -> np.ndarray:
    """[row, tree] weights of the ``number``-th ``DRAWS`` trees."""
    start = (0x9E3779B97F4A7C15 * (number + 1) + 0xD1B54A32D192ED03 * seed) & (2 ** 64 - 1)
    z = hashes.view(np.uint64) + np.uint64(start)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    return POISSON[z.view(np.uint16).reshape(-1, DRAWS)]


def _coded(edges, sizes):
    """(code, y, h) of rows (x, y, h)."""
    def run(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(sizes))
            yield pa.RecordBatch.from_arrays([pa.array(codes_of(to_cells(x, edges), sizes)), batch.column(1), batch.column(2)],
                                             ["code", "y", "h"])
    return run


def _bags(s: Settings, classes: int | None):
    """For each tree the cells of the task's rows (code, y, h) and what the tree's sample holds of them."""
    def run(batches):
        held = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        if not held:
            return
        code, y, h = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = np.argsort(code, kind="stable")
        code, y, h = code[order], y[order], np.ascontiguousarray(h[order])
        cells, at = np.unique(code, return_inverse=True)
        if classes is not None:
            at = at * classes + y.astype(np.int64)
        for number in range(-(-s.trees // DRAWS)):
            weights, rows = draws(h, number, s.seed), []
            for i in range(min(DRAWS, s.trees - number * DRAWS)):
                w = weights[:, i].astype(np.float64)
                if classes is not None:
                    stats = np.bincount(at, w, len(cells) * classes)
                else:
                    stats = np.stack([np.bincount(at, v, len(cells)) for v in (w, w * y, w * y * y)], axis=1)
                rows.append((number * DRAWS + i, cells.tobytes(), stats.tobytes()))
            tree, code_bytes, stat_bytes = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(code_bytes, pa.binary()), pa.array(stat_bytes, pa.binary())],
                                             ["tree", "cells", "stats"])
    return run


def counts(stats: np.ndarray, classes: int | None) -> np.ndarray:
    return stats[..., 0] if classes is None else stats.sum(axis=-1)


def impurity(stats: np.ndarray, classes: int | None) -> np.ndarray:
    """Variance of (weight, sum, sum of squares), or the Gini impurity of class weights; 0 of nothing."""
    n = counts(stats, classes)
    n = np.where(n > 0, n, 1.0)
    if classes is None:
        return np.maximum(stats[..., 2] / n - (stats[..., 1] / n) ** 2, 0.0)
    return 1 - ((stats / n[..., None]) ** 2).sum(axis=-1)


def grow(cells: np.ndarray, stats: np.ndarray, s: Settings, classes: int | None, number: int) -> tuple[Tree, np.ndarray]:
    """The tree of a sample (gain: impurity decrease times weight), and what each node holds of the sample."""
    tree, width = Tree.empty(s.depth), cells.shape[1]
    bins = int(cells.max(initial=0)) + 1
    holds = np.zeros((len(tree.value), stats.shape[1]))
    some = counts(stats, classes) > 0
    cells, stats = cells[some], stats[some]
    node, rng = np.ones(len(cells), np.int64), np.random.default_rng([s.seed, number])
    holds[1] = stats.sum(axis=0)
    least = 1e-12 * float(impurity(holds[1], classes))                  # below, a gain is rounding
    open_nodes = np.array([1] if len(cells) and least > 0 else [], np.int64)
    for level in range(s.depth):
        if not len(open_nodes):
            break
        place = np.full(2 << level, -1)
        place[open_nodes] = np.arange(len(open_nodes))
        at = place[node * (node < 2 << level)]
        here = np.flatnonzero(at >= 0)
        tried = rng.random((len(open_nodes), width)).argsort(axis=1).argsort(axis=1) < (s.subset or width)
        whole = holds[open_nodes]
        n, before = counts(whole, classes), impurity(whole, classes)
        gain, feature, cut = np.zeros(len(open_nodes)), np.full(len(open_nodes), -1), np.zeros(len(open_nodes), np.int64)
        lower = np.zeros_like(whole)
        for j in range(width):
            cell = at[here] * bins + cells[here, j]
            left = np.stack([np.bincount(cell, v, len(open_nodes) * bins) for v in stats[here].T], axis=1)
            left = left.reshape(len(open_nodes), bins, -1).cumsum(axis=1)[:, :-1]
            if not left.shape[1]:
                continue
            right = whole[:, None] - left
            nl, nr = counts(left, classes), counts(right, classes)
            found = before[:, None] - (nl * impurity(left, classes) + nr * impurity(right, classes)) / n[:, None]
            found = np.where((nl >= 1) & (nr >= 1) & tried[:, j, None], found, 0.0)
            first = found.argmax(axis=1)
            most = found[np.arange(len(found)), first]
            better = most > np.maximum(gain, least)
            gain, feature, cut = np.where(better, most, gain), np.where(better, j, feature), np.where(better, first, cut)
            lower = np.where(better[:, None], left[np.arange(len(left)), first], lower)
        split = feature >= 0
        parts = open_nodes[split]
        tree.feature[parts], tree.cut[parts], tree.gain[parts] = feature[split], cut[split], (gain * n)[split]
        holds[2 * parts], holds[2 * parts + 1] = lower[split], whole[split] - lower[split]
        moved = here[tree.feature[node[here]] >= 0]
        up = node[moved]
        node[moved] = 2 * up + (cells[moved, tree.feature[up]] > tree.cut[up])
        children = np.concatenate([2 * parts, 2 * parts + 1])
        open_nodes = np.sort(children[impurity(holds[children], classes) > least])
    _join_equal(tree, holds, classes, s.depth)
    return tree, holds


def _join_equal(tree: Tree, holds: np.ndarray, classes: int | None, depth: int) -> None:
    """A node whose children are leaves of one prediction becomes a leaf, from the lowest level up."""
    said = holds.argmax(axis=1) if classes is not None else holds[:, 1] / np.maximum(holds[:, 0], 1e-300)
    for level in range(depth - 1, -1, -1):
        nodes = np.arange(1 << level, 2 << level)
        both = (tree.feature[nodes] >= 0) & (tree.feature[2 * nodes] < 0) & (tree.feature[2 * nodes + 1] < 0)
        same = nodes[both & (said[2 * nodes] == said[2 * nodes + 1])]
        tree.feature[same], tree.gain[same] = -1, 0.0


def _grown(s: Settings, sizes: list[int], classes: int | None):
    """A tree from the parts of its sample: (tree, payload)."""
    def run(table):
        number, width = table.column("tree")[0].as_py(), 3 if classes is None else classes
        codes = np.concatenate([np.frombuffer(v.as_buffer(), np.int64) for v in table.column("cells")])
        stats = np.concatenate([np.frombuffer(v.as_buffer(), np.float64) for v in table.column("stats")]).reshape(-1, width)
        found, at = np.unique(codes, return_inverse=True)               # a cell may have rows in several parts
        stats = np.stack([np.bincount(at, v, len(found)) for v in stats.T], axis=1)
        tree, holds = grow(cells_of(found, sizes), stats, s, classes, number)
        used = 1 + int(max(1, 2 * np.flatnonzero(tree.feature >= 0).max(initial=0) + 1))
        value = holds / np.maximum(holds.sum(axis=1, keepdims=True), 1e-300) if classes is not None else (
            holds[:, 1:2] / np.maximum(holds[:, :1], 1e-300))
        payload = pickle.dumps((tree.feature[:used].astype(np.int32), tree.cut[:used].astype(np.uint8), tree.gain[:used], value[:used]))
        return pa.table({"tree": pa.array([number], pa.int32()), "payload": pa.array([payload], pa.binary())})
    return run


@dataclass
class ForestModel:
    """``trees``: (feature, cut, gain, value) of the nodes 1, 2, ...; a value is class shares, or a number."""

    edges: list
    sizes: list
    depth: int
    classes: int | None
    trees: list

    def scores(self, cells: np.ndarray) -> np.ndarray:
        """Mean of the values of the leaves in which a row lies."""
        flat, rows = np.ascontiguousarray(cells).reshape(-1), np.arange(len(cells)) * cells.shape[1]
        total = np.zeros((len(cells), self.classes or 1))
        for feature, cut, _, value in self.trees:
            node = np.ones(len(cells), np.int64)
            for _ in range(self.depth):
                at = feature[node]
                if (at < 0).all():
                    break
                node = np.where(at >= 0, 2 * node + (flat.take(rows + at) > cut[node]), node)
            total += value[node]
        return total / len(self.trees)

    def apply(self, df: DataFrame, features: str) -> DataFrame:
        """Adds ``prediction``, and ``probs`` for classes."""
        model = self

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known, values = np.zeros(0, np.int64), np.zeros((0, model.classes or 1))
            for x in parts:
                if not len(x):
                    yield pd.Series([], dtype=object)
                    continue
                codes, at = np.unique(codes_of(to_cells(np.stack(x.to_numpy()), model.edges), model.sizes), return_inverse=True)
                if len(known) > KNOWN:
                    known, values = known[:0], values[:0]
                new = np.setdiff1d(codes, known, assume_unique=True)
                if len(new):
                    known, values = np.r_[known, new], np.r_[values, model.scores(cells_of(new, model.sizes))]
                    order = np.argsort(known)
                    known, values = known[order], values[order]
                yield pd.Series(list(values[np.searchsorted(known, codes)][at]))

        out = df.withColumn("probs", scored(vector_to_array(features)))
        if self.classes is None:
            return out.withColumn("prediction", F.col("probs")[0]).drop("probs")
        return out.withColumn("prediction", most_likely(F.col("probs")))

    @property
    def featureImportances(self):
        """A tree's impurity decreases by feature as shares, the mean of all trees as shares again."""
        from pyspark.ml.linalg import Vectors
        total = np.zeros(len(self.edges))
        for feature, _, gain, _ in self.trees:
            used = feature >= 0
            one = np.bincount(feature[used], gain[used], len(self.edges))
            total += one / one.sum() if one.sum() else one
        return Vectors.dense(total / total.sum() if total.sum() else total)


def fit(df: DataFrame, features: str, label: str, classes: int | None, width: int, rows: int, key: Column,
        settings: Settings = Settings()) -> ForestModel | None:
    """A forest on ``df``: ``classes`` of labels 0, 1, ..., or None for a number; ``key`` tells rows apart.

    None where the rows have too many cells.
    """
    s = settings
    edges = cut_points(df, features, width, rows, BINS)
    sizes = [len(e) + 1 for e in edges]
    if math.prod(sizes) >= 1 << 62:
        return None
    flat = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), F.xxhash64(key, F.lit(s.seed)).alias("h"))
    coded = flat.mapInArrow(_coded(edges, sizes), "code long, y double, h long")
    most = min(CELLS, rows // ROWS_A_CELL)
    coded = materialize(coded)
    if coded.select("code").distinct().limit(most + 1).count() > most:
        return None
    tasks = max(-(-rows // BAG_ROWS), min(shuffle_partitions(df.sparkSession), -(-rows // TASK_ROWS)))
    bags = coded.repartitionByRange(tasks, "code", "h").mapInArrow(_bags(s, classes), "tree int, cells binary, stats binary")
    grown = bags.repartition(s.trees, "tree").groupBy("tree").applyInArrow(_grown(s, sizes, classes), "tree int, payload binary")
    found = {r["tree"]: pickle.loads(r["payload"]) for r in grown.collect()}             # a row a tree
    return ForestModel(edges, sizes, s.depth, classes, [found[i] for i in sorted(found)])
