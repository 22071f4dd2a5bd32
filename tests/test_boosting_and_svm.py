"""Boosted trees and the kernel SVM over row blocks, held against plain versions."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sparkprep.operators import blocks, boosting, kernel_svm
from sparkprep.operators.split import hash_unit


def frame(spark, x, y):
    rows = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a array<double>, label double").select(
        "id", "label", array_to_vector("a").alias("features")).repartition(3)


def plain(x, y, kind, k, s):
    """Scores of the rows after boosting by exhaustive search over the same cut points."""
    cuts = [(np.unique(c)[1:] + np.unique(c)[:-1]) / 2 for c in x.T]
    score = np.zeros((len(x), k)) + (y.mean() if kind == "squared" else 0.0)
    for _ in range(s.rounds):
        g, h = boosting.gradients(kind, score, y)
        add = np.zeros_like(score)

        def grow(c, rows, depth):
            gs, hs = g[rows, c].sum(), h[rows, c].sum()
            best = (s.least_gain, None)
            for j in range(x.shape[1]) if depth < s.depth else ():
                for cut in cuts[j]:
                    left = rows[x[rows, j] < cut]
                    gl, hl = g[left, c].sum(), h[left, c].sum()
                    if hl < s.least_weight or hs - hl < s.least_weight:
                        continue
                    gain = gl ** 2 / (hl + s.penalty) + (gs - gl) ** 2 / (hs - hl + s.penalty) - gs ** 2 / (hs + s.penalty)
                    if gain > best[0] + 1e-12:
                        best = (gain, (j, cut))
            if best[1] is None:
                add[rows, c] = -s.rate * gs / (hs + s.penalty)
                return
            j, cut = best[1]
            grow(c, rows[x[rows, j] < cut], depth + 1)
            grow(c, rows[x[rows, j] >= cut], depth + 1)

        for c in range(k):
            grow(c, np.arange(len(x)), 0)
        score = score + add
    return score


@pytest.mark.parametrize("kind,k", [("softmax", 3), ("logistic", 1), ("squared", 1)])
def test_boosting_equals_exhaustive_search(spark, monkeypatch, kind, k):
    monkeypatch.setattr(boosting, "REFRESH", 3)
    monkeypatch.setattr(boosting, "PASS_VALUES", 200)          # several passes a level
    monkeypatch.setattr(blocks, "TASK_ROWS", 50)               # several tasks
    rng = np.random.RandomState(1)
    x = np.stack([rng.randint(0, 6, 150), rng.randint(0, 4, 150), rng.randint(0, 9, 150)], axis=1).astype(float)
    y = ((x[:, 0] + x[:, 1] * 2 + rng.randint(0, 3, 150)) // 4).clip(0, 2)
    if kind == "logistic":
        y = y.clip(0, 1)
    if kind == "squared":
        y = x[:, 0] * 3 + rng.randint(0, 5, 150)
    s = boosting.Settings(rounds=5, depth=3, least_weight=0.5)
    df = frame(spark, x, y)
    model = boosting.fit(df, "features", "label", {"softmax": 3, "logistic": 2, "squared": None}[kind], 3, 150, s)
    want = plain(x, y, kind, k, s)
    cells = boosting.to_cells(x, model.edges)
    assert np.allclose(boosting.raw_scores(cells, model.start, model.rounds, s.depth), want)
    out = sorted(model.apply(df, "features").collect(), key=lambda r: r.id)
    if kind == "squared":
        assert np.allclose([r.prediction for r in out], want[:, 0])
    else:
        p = boosting.probabilities(kind, want)
        assert np.allclose([r.probs for r in out], p) and [r.prediction for r in out] == p.argmax(axis=1).tolist()
    assert abs(sum(model.featureImportances.toArray()) - 1) < 1e-9


def test_boosting_with_missing_and_constant_features(spark):
    x = np.array([[i % 7, np.nan if i % 3 == 0 else 1.0, 5.0] for i in range(90)])
    y = np.array([1.0 if i % 3 == 0 else 0.0 for i in range(90)])
    model = boosting.fit(frame(spark, x, y), "features", "label", 2, 3, 90, boosting.Settings(rounds=3, depth=2))
    assert [len(e) for e in model.edges] == [6, 0, 0]
    flat = boosting.fit(frame(spark, x[:, 2:], y), "features", "label", 2, 1, 90, boosting.Settings(rounds=2, depth=2))
    assert all((t.feature == -1).all() for trees in flat.rounds for t in trees)


def circles(n=900, seed=3):
    rng = np.random.RandomState(seed)
    x = rng.uniform(-2, 2, (n, 2))
    y = np.where((x ** 2).sum(axis=1) < 1.2, 0, np.where(x[:, 0] * x[:, 1] > 0, 1, 2)).astype(float)
    noisy = rng.rand(n) < 0.15
    y[noisy] = rng.randint(0, 3, noisy.sum())
    return x, y


def test_svm_probabilities_beat_a_softmax_of_margins(spark):
    x, y = circles()
    tx, ty = circles(seed=4)
    df = frame(spark, x, y)
    model = kernel_svm.fit(df, "features", "label", 3, 2, len(x), hash_unit("id", 43) % 3, dims=128)
    out = sorted(model.apply(frame(spark, tx, ty), "features").collect(), key=lambda r: r.id)
    p = np.array([r.probs for r in out])
    assert np.allclose(p.sum(axis=1), 1) and np.mean([r.prediction == t for r, t in zip(out, ty)]) > 0.8
    m = model.margins(tx)
    soft = np.exp(m - m.max(axis=1, keepdims=True))
    soft /= soft.sum(axis=1, keepdims=True)
    truth = np.eye(3)[ty.astype(int)]

    def brier(q):
        return ((q - truth) ** 2).sum(axis=1).mean()

    assert brier(p) < brier(soft) - 0.02


def test_svm_machines_are_at_their_minimum(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TASK_ROWS", 200)
    x, y = circles(400)
    model = kernel_svm.fit(frame(spark, x, y), "features", "label", 3, 2, 400, F.col("id") % 2, folds=2, dims=40)
    z = model.fourier(x)
    for c, w in enumerate(model.weights):
        sign = np.where(y == c, 1.0, -1.0)
        short = np.maximum(0, 1 - sign * (z @ w))
        slope = np.r_[w[:-1], 0] - z.T @ (short * sign)
        assert np.abs(slope).max() < 0.05 * len(x) ** 0.5


def test_logistic_curve_follows_the_counts():
    grid = np.linspace(-kernel_svm.REACH, kernel_svm.REACH, kernel_svm.CELLS)
    p = 1 / (1 + np.exp(-(2.0 * grid - 0.5)))
    weight = np.exp(-grid ** 2) * 1e6
    a, b = kernel_svm.logistic_curve(weight * (1 - p), weight * p)
    assert a == pytest.approx(2.0, rel=1e-3) and b == pytest.approx(-0.5, rel=1e-3)
    a, b = kernel_svm.logistic_curve(np.where(grid < -1, 10.0, 0), np.where(grid > 1, 10.0, 0))
    assert 0 < a < 100


def test_blocks_keep_every_row(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_VALUES", 8)
    x = np.arange(60.0).reshape(20, 3)
    got, tasks = blocks.feature_blocks(frame(spark, x, np.arange(20)), "features", "label", 3, 20)
    held = [r for b in got.collect() for r in np.frombuffer(b.x, np.float64).reshape(-1, 3)[:, 0]]
    assert sorted(held) == [3.0 * i for i in range(20)] and tasks == 1 and max(r.n for r in got.collect()) == 2
    assert got.select(F.sum("n")).first()[0] == 20


def test_a_level_is_one_job(spark, monkeypatch):
    monkeypatch.setattr(blocks, "TASK_ROWS", 30)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 3))
    y = (x[:, 0] > 0).astype(float) + (x[:, 1] > 0)
    df = frame(spark, x, y).repartition(3).persist()
    df.count()

    def jobs(rounds):
        group = f"boost{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        model = boosting.fit(df, "features", "label", 3, 3, 90, boosting.Settings(rounds=rounds, depth=2))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), model

    (few, _), (more, small) = jobs(1), jobs(4)
    assert more - few <= 3 * 2
    monkeypatch.setattr(boosting, "DRIVER_VALUES", 0)           # the same splits where histograms meet by a shuffle
    _, large = jobs(4)
    for a, b in zip(small.rounds, large.rounds, strict=True):
        for s, t in zip(a, b, strict=True):
            assert (s.feature == t.feature).all() and (s.cut == t.cut).all() and np.allclose(s.value, t.value)


def test_forests_keep_the_nodes_of_rows():
    from sparkprep.operators import models
    for zoo in (models.classifiers(), models.regressors()):
        assert zoo["Random Forest"](100, 3).getCacheNodeIds()


@pytest.mark.parametrize("classes", [3, 2, None])
def test_counted_cells_give_the_trees_of_the_rows(spark, monkeypatch, classes):
    rng = np.random.default_rng(8)
    x = np.stack([rng.integers(0, 9, 500), rng.integers(0, 5, 500)], axis=1).astype(float)
    y = (x[:, 0] + 2 * x[:, 1] + rng.integers(0, 5, 500)) * (1.0 if classes is None else 1 / 9)
    y = y if classes is None else np.floor(y).clip(0, classes - 1)
    df, s = frame(spark, x, y), boosting.Settings(rounds=4, depth=3)
    passes = []
    monkeypatch.setattr(boosting, "feature_blocks", lambda *a, **b: passes.append(1) or blocks.feature_blocks(*a, **b))
    few = boosting.fit(df, "features", "label", classes, 2, 500, s)
    assert not passes                                            # no blocks of rows, so no pass a level
    monkeypatch.setattr(boosting, "CELL_VALUES", 0)
    rows = boosting.fit(df, "features", "label", classes, 2, 500, s)
    assert passes and len(few.rounds) == len(rows.rounds) == 4
    for a, b in zip(few.rounds, rows.rounds, strict=True):
        for t, u in zip(a, b, strict=True):
            assert (t.feature == u.feature).all() and (t.cut == u.cut).all()
            assert np.allclose(t.value, u.value) and np.allclose(t.gain, u.gain)


def test_huber_machine_is_at_the_minimum_that_mllib_nears(spark, monkeypatch):
    from pyspark.ml.regression import LinearRegression
    monkeypatch.setattr(blocks, "TASK_ROWS", 200)
    monkeypatch.setattr(kernel_svm, "SLICE", 70)
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, (600, 2))
    y = 50 + 10 * np.sin(x[:, 0]) + 5 * x[:, 1] + rng.standard_t(2, 600)
    df = frame(spark, x, y)
    model = kernel_svm.fit_huber(df, "features", "label", 2, 600, dims=30)

    def loss(w, s):
        r = np.abs(z @ w - y) / s
        return s * (1 + np.where(r <= 1.35, r * r, 2 * 1.35 * r - 1.35 ** 2)).sum()

    z = model.fourier(x)
    best = loss(model.weights, model.scale)
    mapped = spark.createDataFrame([(r.tolist(), float(t)) for r, t in zip(z[:, :-1], y)], "a array<double>, label double").select(
        array_to_vector("a").alias("features"), "label")
    theirs = LinearRegression(loss="huber", maxIter=100).fit(mapped)
    their = loss(np.r_[theirs.coefficients.toArray(), theirs.intercept], theirs.scale)
    assert their * 0.95 < best <= their * (1 + 1e-6)          # theirs stops after 100 iterations
    out = sorted(model.apply(df, "features").collect(), key=lambda r: r.id)
    assert np.allclose([r.prediction for r in out], z @ model.weights)
    flat = kernel_svm.fit_huber(frame(spark, x, np.full(600, 7.0)), "features", "label", 2, 600, dims=10)
    assert np.allclose(flat.fourier(x) @ flat.weights, 7.0)


def test_the_kernel_regressor_keeps_no_projected_rows(spark, monkeypatch):
    monkeypatch.setattr(kernel_svm, "HELD_VALUES", 0)              # many rows
    from sparkprep.operators.models import Sizes
    from sparkprep.plans.training import ModelTrainer
    df = spark.createDataFrame([(i, float(i % 17), float((i * 7) % 11), float(i % 17) * 2 + (i * 7) % 11) for i in range(200)],
                               "id long, a double, b double, y double")
    tr = ModelTrainer(target="y", key="id", problem="regression", models=["SVR"], sizes=Sizes(fourier=32))
    prep = tr.prepare(df)
    trained = tr.train(prep)
    assert tr.log == [] and trained["SVR"].kind == "blocks" and tr.evaluate(prep, trained).first().r2 > 0.8
    prep.release()
