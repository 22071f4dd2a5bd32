"""Correlations of every pairwise-complete subset, against plain ranks and sums."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.operators import correlate


def ranks(v):
    order = sorted(v)
    first = {x: order.index(x) for x in set(order)}
    count = {x: order.count(x) for x in set(order)}
    return np.array([first[x] + (count[x] + 1) / 2 for x in v])


def plain(rows, i, j, ranked):
    pairs = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None and r[i] == r[i] and r[j] == r[j]]
    if len(pairs) < 3:
        return len(pairs), None
    x, y = (np.array(c, float) for c in zip(*pairs))
    if ranked:
        x, y = ranks(x.tolist()), ranks(y.tolist())
    if len(set(x)) == 1 or len(set(y)) == 1:
        return len(pairs), None
    return len(pairs), round(float(np.corrcoef(x, y)[0, 1]), 4)


def table(n=180, seed=1):
    rng = random.Random(seed)
    nan = float("nan")
    rows = []
    for i in range(n):
        a = rng.randint(0, 6)
        rows.append((float(a) if rng.random() > 0.2 else None, a + rng.gauss(0, 2) if rng.random() > 0.3 else nan, float(i % 9),
                     1e9 + rng.random(), 7.0, 0.1 if rng.random() > 0.5 else None, float(rng.randint(0, 1)) if i < 2 else None))
    return rows


@pytest.mark.parametrize("method", ["pearson", "spearman"])
@pytest.mark.parametrize("tile,passes", [(64, 256), (2, 1)])
def test_every_pair_on_its_complete_rows(spark, monkeypatch, method, tile, passes):
    monkeypatch.setattr(correlate, "TILE", tile)
    monkeypatch.setattr(correlate, "PASS_TILES", passes)
    rows = table()
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, `g.1` double").repartition(5)
    got = {(r.idx_a, r.idx_b): (r.n, r.r) for r in correlate.correlations(df, method=method).collect()}
    assert len(got) == 21
    for (i, j), (n, r) in got.items():
        want = plain(rows, i, j, method == "spearman")
        assert n == want[0] and (r is None) == (want[1] is None) and (r is None or r == pytest.approx(want[1], abs=1.01e-4)), (i, j)


def test_jobs_do_not_grow_with_pairs(spark):
    def jobs(cols):
        group = f"spearman{cols}"
        df = spark.createDataFrame([tuple(float((i * (c + 3)) % 11) if (i + c) % 4 else None for c in range(cols)) for i in range(60)],
                                   ", ".join(f"c{c} double" for c in range(cols)))
        spark.sparkContext.setJobGroup(group, group)
        correlate.correlations(df, method="spearman").collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, many = jobs(3), jobs(8)                       # 3 and 28 pairs
    assert many <= few + 2 * 5 + 2                     # what a column adds: the broadcast of its ranks


def test_no_rows(spark):
    df = spark.createDataFrame([], "a double, b double")
    for method in ("pearson", "spearman"):
        r = correlate.correlations(df, method=method).collect()
        assert [(x.n, x.r, x.p) for x in r] == [(0, None, None)]


def test_rows_without_a_value_are_spread(spark):
    """A rank table too wide to broadcast is joined by shuffle; the rows without a value do not meet in one task."""
    rng = random.Random(3)
    rows = [(rng.random() if i % 2 else None, float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(4)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = correlate._ranked(df, ["b", "a"], ["a"], distinct_limit=0)
        gaps = [r["n"] for r in got.where("r1 IS NULL").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(gaps) == 200 and max(gaps) < 100
