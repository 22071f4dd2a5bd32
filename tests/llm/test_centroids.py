import random

import brute
import numpy as np
import pytest

from sparkprep.llm import centroids

KIND = "vec_id long, embedding array<float>, id string, cluster string"


def run(spark, rows, parts=3):
    out = centroids.digest(spark.createDataFrame([(i, v, "i", "c") for i, v in rows], KIND).repartition(parts))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, out.collect()), key=repr)


def expected(rows):
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    return sorted(brute.clusters(kept), key=repr)


def vectors(n, seed=1, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(i % 5, spread) for _ in range(64)]) for i in range(n)]


@pytest.mark.parametrize("cut", [3, 100])
def test_equals_brute_force(spark, monkeypatch, cut):
    monkeypatch.setattr(centroids, "CUT_ROUNDS", cut)
    rows = vectors(150)
    assert run(spark, rows) == expected(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = vectors(12, 2, 3.0)
    rows = good + [(50, None), (51, [1.0] * 63), (52, []), (53, [nan] + [0.0] * 63), (54, [None] + [0.0] * 63), (55, [inf] * 64),
                   (None, good[0][1]), (None, [2.5] * 64), (3, good[3][1]), (3, good[3][1]), (60, [0.0] * 64), (61, [-0.0001] * 64)]
    assert run(spark, rows) == expected(rows)


def test_few_equal_and_no_vectors(spark):
    rows = vectors(3)
    assert run(spark, rows) == expected(rows)
    same = [(i, [0.25] * 64) for i in range(20)]                       # every centroid alike: the first takes all
    assert run(spark, same) == expected(same)
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == []


def test_products_follow_the_changed_components():
    rng = np.random.RandomState(1)
    x = rng.randint(-5000, 5000, (40, 9))
    old, new = rng.randint(-3000, 3000, (4, 9)), None
    new = old.copy()
    new[1, 3] += 7
    new[2] -= rng.randint(0, 2, 9)
    dots = centroids.moved(x, x @ old.T, new - old)
    assert (dots == x @ new.T).all()
    big = np.array([[3 * 10 ** 9, -1]]), np.array([[2 * 10 ** 9], [5]])
    assert centroids.product(*big).tolist() == [[6 * 10 ** 18 - 5]]
    full = ((x[:, None, :] - new[None]) ** 2).sum(axis=2)
    assert (centroids.distances(x, dots, new) == full).all()
