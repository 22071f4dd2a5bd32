"""Kernel support vector classifier: random Fourier features, one-vs-rest margins, fitted probabilities.

The radial kernel is approximated by random cosine features of standardised inputs.  For every
class and every fold a linear machine with the squared hinge loss is fitted by Newton steps; one
pass over the blocks serves all classes and folds, a task adding up the normal equations of the
rows inside each margin.  Every row then gets a margin from the machine that has not seen it (its
fold comes from the hash of its key), and per class a logistic curve through those margins turns a
margin into a probability; a row's probabilities are normalised to sum to one.

The kernel regressor of many rows has the same features and the huber loss with its scale, as in MLlib's huber
regression without a penalty; each Newton step on weights and scale is a pass over the blocks too, so no
projected row is kept.

State on the driver: (classes x (folds + 1)) matrices of the feature dimension squared, whatever
the number of rows.
"""

from __future__ import annotations

import math
import random
import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import each_block, feature_blocks, slot_batch, summed
from .boosting import most_likely

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEPS = 30                     # Newton steps at most; a handful are usual
HELD_VALUES = 1 << 25          # projected values of training rows that the regressor caches for MLlib (256 MB)
SLICE = 16_384                 # rows that are projected at a time
CELLS, REACH = 4001, 20.0      # margins are counted in cells of 0.01 for the logistic curves


@dataclass
class FourierMap:
    """z = sqrt(2/D) cos(W x + b) of inputs standardised by mean and std, with a constant at the end."""

    mean: np.ndarray
    std: np.ndarray
    w: np.ndarray
    b: np.ndarray

    @staticmethod
    def draw(mean, std, dims: int, seed: int) -> "FourierMap":
        """W ~ N(0, 2 gamma), gamma = 1 / (inputs x their variance, which is one)."""
        rng, p = random.Random(seed), len(mean)
        sd = math.sqrt(2.0 / max(p, 1))
        w = np.array([[rng.gauss(0.0, sd) for _ in range(p)] for _ in range(dims)]).reshape(dims, p)
        return FourierMap(np.asarray(mean, float), np.asarray(std, float), w,
                          np.array([rng.uniform(0.0, 2 * math.pi) for _ in range(dims)]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        scaled = (x - self.mean) / np.where(self.std > 0, self.std, 1.0)
        z = np.sqrt(2.0 / len(self.b)) * np.cos(scaled @ self.w.T + self.b)
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)


def moments(df: DataFrame, features: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of every feature."""
    x = vector_to_array(features)
    row = df.select(*[x[i].alias(f"x{i}") for i in range(width)]).agg(
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(width)], *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(width)]).first()
    return (np.array([row[f"m{i}"] or 0.0 for i in range(width)]), np.array([row[f"s{i}"] or 0.0 for i in range(width)]))


def _slices(batches, width: int):
    """(x, y, fold) of a few rows of the blocks at a time."""
    for x, y, fold in each_block(batches, width, np.float64):
        for at in range(0, len(x), SLICE):
            yield x[at:at + SLICE], y[at:at + SLICE], fold[at:at + SLICE]


def _equations(width, fourier, weights, classes, folds):
    """Per (class, fold): loss, and the normal equations of the rows inside the margin; fold ``folds`` leaves out nothing."""
    def run(batches):
        d = len(fourier.b) + 1
        total = {slot: np.zeros(d * d + d + 1) for slot in weights}
        for x, y, fold in _slices(batches, width):
            z = fourier(x)
            for slot, w in weights.items():
                c, f = divmod(slot, folds + 1)
                used = slice(None) if f == folds else fold != f
                zs, sign = z[used], np.where(y[used] == c, 1.0, -1.0)
                short = 1 - sign * (zs @ w)
                inside = short > 0
                zi, si = zs[inside], sign[inside]
                total[slot][:d * d] += (zi.T @ zi).reshape(-1)
                total[slot][d * d:-1] += zi.T @ si
                total[slot][-1] += (short[inside] ** 2).sum()
        yield slot_batch(list(total), list(total.values()))
    return run


def _margins(width, fourier, weights, classes, folds):
    """Counts of out-of-fold margins by class machine, cell, and whether the row is of the class."""
    def run(batches):
        total = np.zeros((classes, 2, CELLS))
        for x, y, fold in _slices(batches, width):
            z = fourier(x)
            for c in range(classes):
                w = np.stack([weights[c * (folds + 1) + f] for f in range(folds)])
                m = (z * w[fold]).sum(axis=1)
                cell = np.clip(((m + REACH) * (CELLS - 1) / (2 * REACH)).round(), 0, CELLS - 1).astype(int)
                for own in (0, 1):
                    total[c, own] += np.bincount(cell[(y == c) == own], minlength=CELLS)
        yield slot_batch(list(range(classes)), list(total))
    return run


def logistic_curve(others: np.ndarray, own: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of P(own | margin) through counted margins, by Newton with step halving.

    Targets are drawn in by one row a side, so classes that margins part wholly keep a finite slope.
    """
    x = np.linspace(-REACH, REACH, CELLS)
    high, low = (own.sum() + 1) / (own.sum() + 2), 1 / (others.sum() + 2)
    n, t = own + others, own * high + others * low
    a, b = 0.0, math.log((own.sum() + 1) / (others.sum() + 1))

    def loss(a, b):
        z = a * x + b
        return float((n * np.logaddexp(0, z) - t * z).sum())

    now = loss(a, b)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -700, 700)))
        r, v = n * p - t, n * p * (1 - p)
        g = np.array([(r * x).sum(), r.sum()])
        h = np.array([[(v * x * x).sum(), (v * x).sum()], [(v * x).sum(), v.sum()]]) + 1e-10 * np.eye(2)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-8 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        new = loss(a, b)
        if now - new < 1e-9 * (1 + abs(now)):
            break
        now = new
    return float(a), float(b)


@dataclass
class KernelSvm:
    fourier: FourierMap
    weights: np.ndarray            # classes x dimensions
    curves: np.ndarray             # classes x (slope, intercept)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights.T

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(self.margins(x) * self.curves[:, 0] + self.curves[:, 1], -700, 700)))
        return p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)

    def apply(self, df: DataFrame, features: str) -> DataFrame:
        """Adds ``probs`` and ``prediction``, the class with the largest margin."""
        model = self

        @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
        def both(x):
            import pandas as pd
            if not len(x):
                return pd.Series([], dtype=object)
            m = np.stack(x.to_numpy())
            return pd.Series([[p, d] for p, d in zip(model.probabilities(m), model.margins(m))])

        out = df.withColumn("__both", both(vector_to_array(features)))
        return (out.withColumn("probs", F.col("__both")[0]).withColumn("prediction", most_likely(F.col("__both")[1]))
                .drop("__both"))


def fit(df: DataFrame, features: str, label: str, classes: int, width: int, rows: int, fold: Column,
        folds: int = 3, dims: int = 256, seed: int = 42, cost: float = 1.0) -> KernelSvm:
    """Machines and curves for labels 0 to ``classes`` - 1; ``fold`` numbers each row's fold from 0."""
    mean, std = moments(df, features, width)
    fourier = FourierMap.draw(mean, std, dims, seed)
    blocks, tasks = feature_blocks(df, features, label, width, rows, fold=fold)
    d = dims + 1
    ridge = np.eye(d)
    ridge[-1, -1] = 1e-9                                      # the constant is not penalised
    weights = {slot: np.zeros(d) for slot in range(classes * (folds + 1))}
    last: dict = {slot: (math.inf, None, 1.0) for slot in weights}        # objective, weights, step of the accepted point
    goal: dict = {}
    open_slots, done = dict(weights), {}
    for _ in range(STEPS):
        sums = summed(blocks.mapInArrow(_equations(width, fourier, open_slots, classes, folds), "slot long, payload binary"),
                      tasks, len(open_slots))
        following = {}
        for slot, w in open_slots.items():
            v = sums[slot]
            value = 0.5 * w @ ridge @ w + 0.5 * cost * v[-1]
            before, accepted, size = last[slot]
            if accepted is not None and value > before + 1e-9 * (1 + abs(before)):
                size /= 2                                     # too long a step: half of it
                if size < 1e-4:
                    done[slot] = accepted
                    continue
                last[slot] = before, accepted, size
                following[slot] = accepted + size * (goal[slot] - accepted)
                continue
            gram, pull = v[:d * d].reshape(d, d), v[d * d:-1]
            goal[slot] = np.linalg.solve(ridge + cost * gram, cost * pull)
            if accepted is not None and before - value < 1e-6 * (1 + abs(before)):
                done[slot] = w
                continue
            last[slot] = value, w, 1.0
            following[slot] = goal[slot]
        open_slots = following
        if not open_slots:
            break
    for slot, w in open_slots.items():
        done[slot] = last[slot][1] if last[slot][1] is not None else w
    counted = summed(blocks.mapInArrow(_margins(width, fourier, done, classes, folds), "slot long, payload binary"), tasks, classes)
    curves = [logistic_curve(*counted[c].reshape(2, CELLS)) for c in range(classes)]
    return KernelSvm(fourier, np.stack([done[c * (folds + 1) + folds] for c in range(classes)]), np.array(curves))


@dataclass
class KernelHuber:
    fourier: FourierMap
    weights: np.ndarray
    scale: float

    def apply(self, df: DataFrame, features: str) -> DataFrame:
        """Adds ``prediction``."""
        model = self

        @F.pandas_udf("double")
        def scored(x):
            import pandas as pd
            return pd.Series(model.fourier(np.stack(x.to_numpy())) @ model.weights if len(x) else [], dtype=float)

        return df.withColumn("prediction", scored(vector_to_array(features)))


def _huber(width, fourier, weights, scale, bend):
    """Normal equations of the rows within ``bend`` scales of their value (of all rows without ``weights``), the pull of the
    others, and (rows within, others, squares of the values within, loss)."""
    def run(batches):
        d = len(fourier.b) + 1
        total = np.zeros(d * d + 2 * d + 4)
        for x, y, _ in _slices(batches, width):
            z = fourier(x)
            zi, yi = z, y
            if weights is not None:
                r = (z @ weights - y) / scale
                far = np.abs(r) > bend
                zi, yi = z[~far], y[~far]
                total[d * d + d:-4] += z[far].T @ np.sign(r[far])
                total[-3] += far.sum()
                total[-1] += scale * (len(r) + (r[~far] ** 2).sum() + (2 * bend * np.abs(r[far]) - bend * bend).sum())
            total[:d * d] += (zi.T @ zi).reshape(-1)
            total[d * d:d * d + d] += zi.T @ yi
            total[-4] += len(yi)
            total[-2] += yi @ yi
        yield slot_batch([0], [total])
    return run


def fit_huber(df: DataFrame, features: str, label: str, width: int, rows: int, dims: int = 256, seed: int = 42, steps: int = 100,
              bend: float = 1.35) -> KernelHuber:
    """Weights and scale of the least huber loss, by ``steps`` Newton steps at most; the first is least squares."""
    fourier = FourierMap.draw(*moments(df, features, width), dims, seed)
    blocks, tasks = feature_blocks(df, features, label, width, rows)
    d = dims + 1
    weights, scale, size, held, goal = None, 1.0, 1.0, None, None
    for _ in range(steps + 1):
        v = summed(blocks.mapInArrow(_huber(width, fourier, weights, scale, bend), "slot long, payload binary"), tasks, 1)[0]
        if weights is not None:
            if held is not None and v[-1] > held[0] + 1e-12 * abs(held[0]):
                size /= 2                                         # too long a step: half of it
                if size < 1e-3:
                    break
                weights, scale = held[1] + size * (goal[0] - held[1]), held[2] + size * (goal[1] - held[2])
                continue
            settled = held is not None and held[0] - v[-1] < 1e-7 * abs(held[0])
            held, size = (v[-1], weights, scale), 1.0
            if settled:
                break
        gram, pull, push, (near, far, squares, _) = v[:d * d].reshape(d, d), v[d * d:d * d + d], v[d * d + d:-4], v[-4:]
        # of rows within, z w = y; the others pull by bend * scale: w = a - scale * c, and the scale follows
        ridge = np.eye(d) * (1e-10 * max(np.trace(gram), 1e-300) / d)
        a, c = np.linalg.solve(gram + ridge, np.stack([pull, bend * push], axis=1)).T
        left = max(squares - 2 * a @ pull + a @ gram @ a, 1e-24 * max(squares, 1.0))
        free = near + far - bend * bend * far - c @ gram @ c
        to = math.sqrt(left / free) if free > 0 else 2 * scale
        goal = a - to * c, to
        weights, scale = goal
    _, weights, scale = held if held is not None else (None, weights, scale)
    return KernelHuber(fourier, weights, scale)
