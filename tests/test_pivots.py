"""The pivot join against brute force: same rows, fewer comparisons."""

import random

import pytest

from sparkprep.operators import pivots


def brute(queries, donors, k, factors=None):
    out = []
    for lane, q, x in queries:
        if x is None or any(v is None or v != v for v in x):
            continue
        near = sorted((((factors or {}).get(lane, 1.0) * sum((a - b) ** 2 for a, b in zip(x, dx))) ** 0.5, key, y)
                      for dl, key, dx, y in donors if dl == lane and dx is not None and all(v is not None and v == v for v in dx))
        out += [(lane, q, key, y, round(d, 9)) for d, key, y in near[:k]]
    return sorted(out, key=repr)


def run(spark, queries, donors, k, factors=None, key="long"):
    q = spark.createDataFrame(queries, f"lane int, q {key}, x array<double>").repartition(3)
    d = spark.createDataFrame(donors, f"lane int, key {key}, x array<double>, y string").repartition(4)
    found = pivots.nearest(q, d, k, factors)
    return sorted(((r.lane, r.q, r.key, r.y, round(r.d, 9)) for r in found.rows.collect()), key=repr), found


@pytest.fixture
def small(monkeypatch):
    for name, value in (("BLOCK_ROWS", 7), ("CHUNK_ROWS", 5), ("SALTS", 2), ("PIVOTS", 9)):
        monkeypatch.setattr(pivots, name, value)


@pytest.mark.parametrize("dims", [1, 2, 8])
def test_equals_brute_force(spark, small, dims):
    rng = random.Random(dims)
    donors = [(0, i, [rng.randint(0, 6) + rng.choice([0.0, 0.5]) for _ in range(dims)], f"y{i % 3}") for i in range(150)]
    donors += [(0, 200 + i, donors[3][2], "copy") for i in range(40)]                      # equal rows: first k by key
    donors += [(1, i, [rng.gauss(0, 1) for _ in range(dims)], "z") for i in range(30)]
    queries = [(lane, q, [rng.uniform(-1, 8) for _ in range(dims)]) for lane in (0, 1) for q in range(25)]
    queries += [(0, 99, donors[3][2]), (1, 99, [1e9] * dims), (2, 1, [0.0] * dims)]
    factors = {0: 1.0, 1: 2.5}
    got, _ = run(spark, queries, donors, 5, factors)
    assert got == brute(queries, donors, 5, factors)


def test_few_odd_and_text_keys(spark):
    nan = float("nan")
    donors = [(0, "b", [0.0, 0.0], "1"), (0, "a", [0.0, 0.0], None), (0, "n", [nan, 1.0], "x"), (0, "m", None, "x"), (0, "c", [1.0, None], "x")]
    queries = [(0, "q", [0.0, 0.0]), (0, "r", [nan, 0.0]), (0, "s", None)]
    assert run(spark, queries, donors, 3, key="string")[0] == brute(queries, donors, 3) == [
        (0, "q", "a", None, 0.0), (0, "q", "b", "1", 0.0)]
    assert run(spark, queries, [], 3, key="string")[0] == [] and run(spark, [], donors, 3, key="string")[0] == []


def test_compares_a_small_part_of_all_pairs(spark):
    rng = random.Random(5)
    centers = [[rng.uniform(0, 100) for _ in range(6)] for _ in range(20)]
    donors = [(0, i, [c + rng.gauss(0, 0.5) for c in centers[i % 20]], "y") for i in range(6000)]
    queries = [(0, i, [c + rng.gauss(0, 0.5) for c in centers[i % 20]]) for i in range(400)]
    got, found = run(spark, queries[:40], donors, 5)
    assert got == brute(queries[:40], donors, 5)
    q = spark.createDataFrame(queries, "lane int, q long, x array<double>")
    d = spark.createDataFrame(donors, "lane int, key long, x array<double>, y string")
    assert pivots.nearest(q, d, 5).pairs_compared() < 0.2 * 6000 * 400


def test_one_cell_of_many_rows_is_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 50)
    donors = [(0, i, [float(i % 700) / 1e6], "y") for i in range(2000)] + [(0, 5000 + i, [1e6 + i], "far") for i in range(3)]
    queries = [(0, i, [float(i) / 1e6]) for i in range(0, 700, 50)]
    got, found = run(spark, queries, donors, 4)
    assert got == brute(queries, donors, 4) and max(r.donors for r in found.met.collect()) <= 50


def test_a_query_meets_no_more_rows_when_there_are_more(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 64), ("CHUNK_ROWS", 16), ("PIVOTS", 9)):
        monkeypatch.setattr(pivots, name, value)
    rng, met = random.Random(8), []
    queries = [(0, i, [rng.uniform(0, 1000), rng.uniform(0, 9)]) for i in range(100)]
    for n in (1500, 12000):
        donors = [(0, i, [rng.uniform(0, 1000), rng.uniform(0, 9)], "y") for i in range(n)]
        got, found = run(spark, queries, donors, 5)
        met.append(found.pairs_compared())
        assert n > 1500 or got == brute(queries, donors, 5)
    assert met[1] < 2 * met[0]


def test_sampled_trees_and_a_leaf_of_many_queries(spark, monkeypatch):
    from sparkprep.operators import kdtree
    for module, name, value in ((pivots, "BLOCK_ROWS", 40), (kdtree, "LEAVES", 64), (kdtree, "TASK_QUERIES", 10), (kdtree, "PAIRS", 300)):
        monkeypatch.setattr(module, name, value)
    rng = random.Random(9)
    donors = [(lane, i, [1e9 + rng.choice([0.0, rng.random()]), float(rng.randint(0, 40)), rng.gauss(0, 1e-3)], "y") for lane in (0, 1) for i in range(1500)]
    queries = [(0, i, donors[7][2]) for i in range(60)] + [(1, i, [1e9, rng.uniform(-5, 45), 0.0]) for i in range(60)]
    queries += [(1, 99, [float("inf"), 1.0, 0.0])]
    factors = {0: 3.0, 1: 1.5}
    assert run(spark, queries, donors, 4, factors)[0] == brute(queries, donors, 4, factors)
