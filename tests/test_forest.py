"""Forests grown from counted cells, held against an exhaustive search over rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sparkprep.operators import forest
from sparkprep.operators.models import Sizes
from sparkprep.plans.training import ModelTrainer


def plain(x, y, w, depth, classes):
    """What a tree says of each row, by exhaustive search over the weighted rows."""
    out = np.zeros((len(x), classes or 1))

    def stats(rows):
        if classes is not None:
            return np.bincount(y[rows].astype(int), w[rows], classes)
        return np.array([w[rows].sum(), (w * y)[rows].sum(), (w * y * y)[rows].sum()])

    def impurity(s):
        if classes is not None:
            return s.sum() * (1 - ((s / s.sum()) ** 2).sum())
        return s[2] - s[1] ** 2 / s[0]

    def pure(rows):
        s = stats(rows)
        out[rows] = s / s.sum() if classes is not None else s[1] / s[0]
        return int(s.argmax()) if classes is not None else None

    def part(rows, level):
        here, best = impurity(stats(rows)), (1e-9, None)
        if level < depth and here > 1e-9:
            for j in range(x.shape[1]):
                for cut in np.unique(x[rows, j])[:-1]:
                    low = x[rows, j] <= cut
                    if w[rows[low]].sum() < 1 or w[rows[~low]].sum() < 1:
                        continue
                    gain = here - impurity(stats(rows[low])) - impurity(stats(rows[~low]))
                    if gain > best[0] + 1e-9:
                        best = (gain, low)
        if best[1] is None:
            return pure(rows)
        said = {part(rows[best[1]], level + 1), part(rows[~best[1]], level + 1)}
        if len(said) == 1 and None not in said:               # two leaves of one class are one
            return pure(rows)
        return None

    part(np.arange(len(x)), 0)
    return out


@pytest.mark.parametrize("classes", [3, None])
def test_a_tree_equals_exhaustive_search(classes):
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 6, 400), rng.integers(0, 4, 400), rng.integers(0, 5, 400)], axis=1)
    y = (x[:, 0] * 2 + x[:, 1] + rng.integers(0, 4, 400)).astype(float)
    y = y % 3 if classes else y * 1000
    w = rng.poisson(1.0, 400).astype(float)
    sizes = [6, 4, 5]
    codes, at = np.unique(forest.codes_of(x, sizes), return_inverse=True)
    if classes:
        stats = np.bincount(at * 3 + y.astype(int), w, len(codes) * 3).reshape(-1, 3)
    else:
        stats = np.stack([np.bincount(at, v, len(codes)) for v in (w, w * y, w * y * y)], axis=1)
    assert (forest.cells_of(forest.codes_of(x, sizes), sizes) == x).all()
    s = forest.Settings(trees=1, depth=4)
    tree, holds = forest.grow(forest.cells_of(codes, sizes), stats, s, classes, 0)
    value = holds / np.maximum(holds.sum(axis=1, keepdims=True), 1e-300) if classes else holds[:, 1:2] / np.maximum(holds[:, :1], 1e-300)
    model = forest.ForestModel([0] * 3, sizes, 4, classes, [(tree.feature, tree.cut, tree.gain, value)])
    own = w > 0
    assert np.allclose(model.scores(x)[own], plain(x[own], y[own], w[own], 4, classes)[:, :classes or 1])


def test_weights_are_poisson_and_differ_by_tree():
    w = np.concatenate([forest.draws(np.arange(200_000, dtype=np.int64) * 7919, i, 42) for i in range(2)], axis=1).astype(float)
    assert np.abs(w.mean(axis=0) - 1).max() < 0.02 and np.abs(w.var(axis=0) - 1).max() < 0.03
    assert np.abs((w == 0).mean(axis=0) - np.exp(-1)).max() < 0.01
    assert np.abs(np.corrcoef(w.T) - np.eye(8)).max() < 0.02


def frame(spark, n=600):
    rows = [(i, [float(i % 6), float((i // 6) % 5)], float((i % 6 + (i // 6) % 5 + i % 2) // 4)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a array<double>, label double").select(
        "id", "label", array_to_vector("a").alias("features"))


def test_a_forest_does_not_depend_on_partitions(spark, monkeypatch):
    df, s = frame(spark), forest.Settings(trees=6, depth=4, subset=1)
    one = forest.fit(df.coalesce(1), "features", "label", 3, 2, 600, F.col("id"), s)
    monkeypatch.setattr(forest, "BAG_ROWS", 90)                  # cells in several tasks
    other = forest.fit(df.repartition(5), "features", "label", 3, 2, 600, F.col("id"), s)
    assert len(one.trees) == 6
    for a, b in zip(one.trees, other.trees, strict=True):
        assert all(np.allclose(u, v) for u, v in zip(a, b, strict=True))
    out = one.apply(df, "features").collect()
    assert all(abs(sum(r.probs) - 1) < 1e-9 and r.prediction == np.argmax(r.probs) for r in out)
    assert np.mean([r.prediction == r.label for r in out]) > 0.7 and abs(sum(one.featureImportances.toArray()) - 1) < 1e-9
    assert forest.fit(df, "features", "label", 3, 2, 8 * 30 - 1, F.col("id"), s) is None       # too many cells for the rows


def test_the_trainer_grows_forests_from_cells(spark):
    rows = [(i, float(i % 7), float((i * 7) % 5), "xy"[(i % 7) // 4], float(i % 7) * 2 + (i * 7) % 5) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, a double, b double, cls string, y double")
    small = Sizes(trees=5, depth=4)
    for target, other, at_least in (("cls", "y", 0.9), ("y", "cls", 0.8)):
        tr = ModelTrainer(target=target, key="id", problem="classification" if target == "cls" else "regression", sizes=small,
                          models=["Random Forest"])
        prep = tr.prepare(df.drop(other))
        trained = tr.train(prep)
        assert tr.log == [] and trained["Random Forest"].kind == "blocks"
        assert tr.evaluate(prep, trained).first()["accuracy" if target == "cls" else "r2"] > at_least
        assert [n for n, _ in trained["Random Forest"].importances()] == prep.slots
        prep.release()


def test_the_rows_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return float(v)

    df = spark.range(200).select("id", counted("id").alias("a"), (F.col("id") * 2.0).alias("y"))
    prep = ModelTrainer(target="y", key="id", problem="regression").prepare(df)
    assert prep.n_train + prep.n_test == 200 and seen.value <= 400        # for the filter on gaps and for the column
    prep.release()
