import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.llm import topk

KIND = "vec_id long, embedding array<float>, id string, score string"


def run(spark, rows, k=10, parts=3):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], KIND).repartition(parts)
    ints = topk.integer_vectors(df, "vec_id", "embedding")
    return sorted(map(tuple, topk.top_k(ints, ints.where(F.col("id") % 100 == 0), k).collect()))


def ints(rows):
    return [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 50)
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(320)]
    rows += [(400 + i, list(rows[i % 7][1])) for i in range(40)]            # equal vectors: ties by id
    rows.append((500, [0.0] * 6))                                          # every score ties at zero
    assert run(spark, rows) == sorted(brute.top_k(ints(rows)))


def test_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = random.Random(2)
    rows = [(i * 50, [rng.random() for _ in range(3)]) for i in range(20)]
    assert run(spark, rows, k=3) == sorted(brute.top_k(ints(rows), 3))


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [9.0, 9.0]),
            (5, [0.5, -0.5]), (6, [1.0, 2.0, 3.0]), (7, []), (100, [-1.0, 0.25]), (200, None)]
    good = ints([(0, rows[0][1]), (5, rows[6][1]), (100, rows[9][1])])
    assert run(spark, rows) == sorted(brute.top_k(good))
    assert run(spark, [(1, [1.0])]) == [] and run(spark, []) == []


def test_stops_before_the_lists_end():
    rng = np.random.RandomState(3)
    vecs = rng.randint(0, 100, (5000, 4)).astype(np.int64)
    vecs[17] = 10_000
    none = np.zeros(0, np.int64)
    score, found, depth = topk.threshold_topk(topk.Block(vecs, np.arange(5000)), np.array([1, 2, 3, 4]), -1, 1, none, none)
    assert found.tolist() == [17] and depth < 100


def test_reads_below_half_of_dense_lists():
    rng = np.random.RandomState(4)
    block = topk.Block((rng.randn(8192, 64) * 300).astype(np.int64), np.arange(8192))
    none = np.zeros(0, np.int64)
    for _ in range(5):
        q = (rng.randn(64) * 300).astype(np.int64)
        score, found, depth = topk.threshold_topk(block, q, -1, 10, none, none)
        want = np.lexsort((block.ids, -(block.vecs @ q)))[:10]
        assert found.tolist() == want.tolist() and depth < block.n / 2


@pytest.mark.parametrize("scale", [1, 10 ** 8])
def test_scores_are_exact_integers(scale):
    vecs = np.array([[3 * scale, -5 * scale], [7 * scale, 11 * scale + 1]], np.int64)
    none = np.zeros(0, np.int64)
    q = np.array([scale + 1, scale - 1])
    score, found, _ = topk.threshold_topk(topk.Block(vecs, np.array([1, 2])), q, 9, 2, none, none)
    assert dict(zip(found.tolist(), score.tolist())) == {i: int(v[0]) * int(q[0]) + int(v[1]) * int(q[1]) for i, v in zip((1, 2), vecs)}
