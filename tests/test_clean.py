"""Cleaning operators on the hand-made fixtures."""

import pytest
from pyspark.sql import functions as F

from sparkprep.operators import clean, impute, neighbors, outliers


def test_sentinels(spark):
    vals = [-999.0, -9999.0, -1.0, -500.0, -12.0, -3.2, 7.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v double")
    got = [r.v for r in clean.mask_sentinels(df, ["v"]).orderBy("id").collect()]
    assert got == [None, None, None, -500.0, -12.0, -3.2, 7.0, None]
    same = [r.v for r in clean.mask_sentinels(df, ["v"], sentinels=[]).orderBy("id").collect()]
    assert same == vals
    assert clean.sentinel_count(df, ["v"]).collect()[0]["masked"] == 3


def test_dupes(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (1, None), (2, "y")], "a long, b string")
    assert clean.drop_duplicates(df).count() == 3
    assert clean.duplicate_count(df).collect()[0]["duplicates"] == 2
    # idempotent
    assert clean.drop_duplicates(clean.drop_duplicates(df)).count() == 3


def test_critical(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, None, "x"), (3, None, None)],
                               "id long, price double, note string")
    kept = clean.drop_on_critical(df, ["price"])
    assert [r.id for r in kept.collect()] == [1]
    assert df.count() - kept.count() == 2
    assert clean.drop_on_critical(df, []).count() == 3


def test_fill_order(spark):
    rows = [(1, None, None), (2, 4.0, "a"), (3, None, None), (4, 6.0, "b"), (5, None, None)]
    df = spark.createDataFrame(rows, "t long, v double, s string")
    f = impute.ffill(df, "t").orderBy("t").collect()
    b = impute.bfill(df, "t").orderBy("t").collect()
    assert [r.v for r in f] == [None, 4.0, 4.0, 6.0, 6.0]
    assert [r.s for r in f] == [None, "a", "a", "b", "b"]
    assert [r.v for r in b] == [4.0, 4.0, 6.0, 6.0, None]
    assert [r.s for r in b] == ["a", "a", "b", "b", None]


def test_fill_many_buckets(spark):
    # more rows than buckets: carries must cross bucket borders
    rows = [(t, float(t) if t % 97 == 0 else None) for t in range(1, 2001)]
    df = spark.createDataFrame(rows, "t long, v double")
    f = {r.t: r.v for r in impute.ffill(df, "t", buckets=16).collect()}
    last = None
    for t in range(1, 2001):
        if t % 97 == 0:
            last = float(t)
        assert f[t] == last


def test_mode_tie(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "a"), (5, "c"), (6, None)], "id long, s string")
    out, fills = impute.mode_fill(df, ["s"])
    assert fills == {"s": "a"}
    assert out.where("id = 6").collect()[0].s == "a"
    empty = spark.createDataFrame([(1, None), (2, None)], "id long, s string")
    _, fills = impute.mode_fill(empty, ["s"])
    assert fills == {"s": "Unknown"}


def test_knn(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0), (2, 1.0, 20.0), (3, 3.0, 30.0), (4, 2.0, None)],
                               "id long, x double, y double")
    out = {r.id: r.y for r in neighbors.knn_impute(df, "id", ["x", "y"], k=2).collect()}
    assert out[4] == pytest.approx(25.0) and out[1] == 10.0


def test_knn_zero(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0), (2, 1.0, 20.0), (3, 1.0, None)], "id long, x double, y double")
    out = {r.id: r.y for r in neighbors.knn_impute(df, "id", ["x", "y"], k=2).collect()}
    assert out[3] == 20.0


def test_knn_brute_force(spark):
    """Grid search equals brute force on a skewed fixture (a hot x value)."""
    import math
    import random
    rng = random.Random(7)
    rows = []
    for i in range(300):
        x = 5.0 if i % 3 == 0 else rng.uniform(0, 100)          # a third share one x
        y = rng.uniform(0, 50)
        z = None if i % 7 == 0 else rng.uniform(0, 10)
        rows.append((i, x, y, z))
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    got = {r.id: r.z for r in neighbors.knn_impute(df, "id", ["x", "y", "z"], k=3).collect()}
    for i, x, y, z in rows:
        if z is not None:
            continue
        cands = []
        for j, x2, y2, z2 in rows:
            if z2 is None:
                continue
            d = math.sqrt(3 / 2 * ((x - x2) ** 2 + (y - y2) ** 2))
            cands.append((d, j, z2))
        top = sorted(cands)[:3]
        zero = [v for d, _, v in top if d == 0]
        want = sum(zero) / len(zero) if zero else sum(v / d for d, _, v in top) / sum(1 / d for d, _, _ in top)
        assert abs(got[i] - want) < 1e-9


def test_iqr(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 100])], "id long, v double")
    fence = outliers.iqr_fences(df, ["v"])["v"]
    assert (fence.q1, fence.q3, fence.lower, fence.upper) == (2.0, 4.0, -1.0, 7.0)
    flagged = outliers.iqr_flags(df, "v").where("is_outlier").collect()
    assert [r.v for r in flagged] == [100.0]
    capped = sorted(r.v for r in outliers.cap_iqr(df, "v").collect())
    assert capped == [1.0, 2.0, 3.0, 4.0, 7.0]
    # capping with fixed fences is idempotent
    again = sorted(r.v for r in outliers.cap_columns(outliers.cap_iqr(df, "v"), {"v": fence}).collect())
    assert again == capped
    kept = outliers.drop_outliers(outliers.iqr_flags(df, "v"), "is_outlier")
    assert kept.count() + len(flagged) == df.count()


def test_iqr_distributed_matches_builtin(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    from sparkprep.operators.quantiles import quantile_map
    cols = ["l_extendedprice", "l_quantity", "l_discount"]
    from sparkprep.operators.quantiles import _refine
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    a = quantile_map(df, cols, probs, "builtin")
    b = quantile_map(df, cols, probs, "distributed")
    c_ = quantile_map(df, cols, probs, "refine")
    f_ = quantile_map(df, cols, probs, "frequency")
    h_ = quantile_map(df, cols, probs, "auto")
    # tiny sketch and collect bound: forces several narrowing rounds
    d = {r["column"]: {} for r in []}
    for r in _refine(df, cols, probs, max_collect=40).collect():
        d.setdefault(r["column"], {})[r["prob"]] = r["value"]
    for c in cols:
        for p in a[c]:
            assert abs(a[c][p] - b[c][p]) < 1e-9
            assert abs(a[c][p] - f_[c][p]) < 1e-9
            assert abs(a[c][p] - h_[c][p]) < 1e-9
            assert abs(a[c][p] - c_[c][p]) < 1e-9
            assert abs(a[c][p] - d[c][p]) < 1e-9


def test_zscore(spark):
    vals = [1.0] * 10 + [100.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, v double")
    flags = {r.id: r.is_outlier for r in outliers.zscore_flags(df, "v", 3.0).collect()}
    assert flags[10] is True and flags[11] is False and sum(flags.values()) == 1


def test_constant_column(spark):
    from sparkprep.operators import correlate, profile, scale
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 3.0)], "c double, x double")
    assert [r.c for r in scale.fit_scaler(df, "minmax", ["c"]).apply(df).collect()] == [0.0] * 3
    assert [r.c for r in scale.fit_scaler(df, "standard", ["c"]).apply(df).collect()] == [0.0] * 3
    assert outliers.zscore_flags(df, "c").where("is_outlier").count() == 0
    d = profile.describe(df, ["c"]).collect()[0]
    assert d.skewness == 0.0 and d.skew_label == "Symmetric"
    corr = correlate.correlations(df, ["c", "x"]).collect()[0]
    assert corr.r is None


def test_knn_no_complete_column_brute_force(spark):
    """Every column has gaps: presence-pattern lanes must still equal brute force."""
    import math
    import random
    rng = random.Random(11)
    rows = []
    for i in range(240):
        x = None if i % 5 == 0 else rng.uniform(0, 100)
        y = None if i % 7 == 0 else float(rng.randint(0, 5))       # heavy ties
        z = None if i % 3 == 0 else rng.uniform(0, 10)
        rows.append((i, x, y, z))
    df = spark.createDataFrame(rows, "id long, x double, y double, z double")
    got = {r.id: (r.x, r.y, r.z) for r in neighbors.knn_impute(df, "id", ["x", "y", "z"], k=4).collect()}
    cols = 3
    means = [sum(r[c] for r in rows if r[c] is not None) / sum(1 for r in rows if r[c] is not None)
             for c in (1, 2, 3)]
    for r in rows:
        for c in (1, 2, 3):
            if r[c] is not None:
                continue
            cands = []
            for d in rows:
                if d[c] is None:
                    continue
                both = [j for j in (1, 2, 3) if r[j] is not None and d[j] is not None]
                if not both:
                    continue
                dist = math.sqrt(cols / len(both) * sum((r[j] - d[j]) ** 2 for j in both))
                cands.append((dist, d[0], d[c]))
            top = sorted(cands)[:4]
            if not top:
                want = means[c - 1]
            else:
                zero = [v for dd, _, v in top if dd == 0]
                want = (sum(zero) / len(zero) if zero else
                        sum(v / dd for dd, _, v in top) / sum(1 / dd for dd, _, _ in top))
            assert got[r[0]][c - 1] == pytest.approx(want, rel=1e-9, abs=1e-9), (r, c)
