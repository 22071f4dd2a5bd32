"""Profiling, correlation, encoding, problem type and metrics fixtures."""

import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from sparkprep.operators import correlate, encode, impute, metrics, profile, split


def test_moments(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2.5, 4, 10, -3, 7.5]], "x double")
    d = profile.describe(df, ["x"], digits=10).collect()[0]
    assert d.skewness == pytest.approx(0.2007813723, abs=1e-9)
    assert d.kurtosis == pytest.approx(-0.0237321224, abs=1e-9)
    assert (d.p25, d.p50, d.p75) == (1.5, 2.5, 5.75)
    assert d.std == pytest.approx(4.2859126938, abs=1e-9)
    assert d.skew_label == "Symmetric"


def test_corr(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 5.0), (None, 9.0)], "x double, y double")
    c = correlate.correlations(df, ["x", "y"], digits=None).collect()[0]
    assert c.n == 3 and c.r == pytest.approx(0.9819805061, abs=1e-9)
    o = correlate.ols_by_group(df, "x", "y").collect()[0]
    assert o.slope == pytest.approx(1.5) and o.intercept == pytest.approx(1 / 3) and o.n == 3


def test_corr_small(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None)], "x double, y double")
    c = correlate.correlations(df, ["x", "y"]).collect()[0]
    assert c.n == 1 and c.r is None and c.p is None


def test_pvalue_closed_forms():
    for t in (0.3, 1.0, 2.5, 10.0):
        assert correlate.t_two_sided_p(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(abs(t)), abs=1e-12)
        assert correlate.t_two_sided_p(t, 2) == pytest.approx(1 - abs(t) / math.sqrt(2 + t * t), abs=1e-12)


def test_spearman_matches_pearson_on_ranks(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 1.0), (4.0, 9.0), (4.0, 2.0)], "x double, y double")
    s = correlate.correlations(df, ["x", "y"], "spearman", digits=None).collect()[0]
    # average ranks by hand
    rx = [1, 2, 3, 4.5, 4.5]
    ry = [3.5, 3.5, 1, 5, 2]
    mx, my = sum(rx) / 5, sum(ry) / 5
    cov = sum((a - mx) * (b - my) for a, b in zip(rx, ry))
    r = cov / math.sqrt(sum((a - mx) ** 2 for a in rx) * sum((b - my) ** 2 for b in ry))
    assert s.r == pytest.approx(r, abs=1e-12)


def test_temporal(spark):
    d = ["2023-01-0%d" % i for i in range(1, 9)] + ["soon", "later"]
    t = ["2023-02-0%d" % i for i in range(1, 8)] + ["x", "y", "z"]
    n = [str(100 + i) for i in range(10)]
    df = spark.createDataFrame(list(zip(d, t, n)), "d string, t string, n string")
    assert impute.detect_temporal(df) == ["d"]


def test_encode(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, "a"), (5, None)], "id long, s string")
    enc = encode.fit_label_encoding(df, ["s"])
    assert enc.mapping == {"s": ["a", "b", "c"]}
    got = {r.id: r.s for r in enc.apply(df).collect()}
    assert got == {1: 1, 2: 0, 3: 2, 4: 0, 5: 3}
    oh = encode.fit_onehot(df, ["s"]).apply(df)
    assert oh.columns == ["id", "s_a", "s_b", "s_c"]
    row5 = oh.where("id = 5").collect()[0]
    assert (row5.s_a, row5.s_b, row5.s_c) == (0, 0, 0)


def test_problem(spark):
    rows = [(f"c{i % 3}", i % 20, float(i)) for i in range(21)]
    df = spark.createDataFrame(rows, "t1 string, t2 long, t3 double")
    assert [split.detect_problem_type(df, t) for t in ("t1", "t2", "t3")] == \
        ["classification", "classification", "regression"]


def test_split_disjoint(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "k")
    tr, te = split.hash_split(df, "k", 0.2, 42)
    assert tr.count() + te.count() == 1000
    assert tr.join(te, "k").count() == 0
    # independent of partitioning
    tr2, te2 = split.hash_split(df.repartition(7), "k", 0.2, 42)
    assert sorted(r.k for r in te.collect()) == sorted(r.k for r in te2.collect())


def test_preds_clf(spark):
    df = spark.createDataFrame([(1, 1, .9), (1, 0, .4), (0, 0, .4), (0, 1, .6)],
                               "actual int, predicted int, score double")
    m = metrics.classification_metrics(df, "actual", "predicted", positive=1).collect()[0]
    assert (m.accuracy, m.precision, m.recall, m.f1) == (0.5, 0.5, 0.5, 0.5)
    assert metrics.roc_auc(df, "actual", "score", 1).collect()[0].auc == pytest.approx(0.625)


def test_preds_reg(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0)], "actual double, predicted double")
    m = metrics.regression_metrics(df, "actual", "predicted").collect()[0]
    assert (m.mae, m.mse, m.rmse, m.r2) == (0.6667, 0.6667, 0.8165, 0.0)


def test_confusion_union(spark):
    df = spark.createDataFrame([(0, 0), (1, 2), (1, 1)], "actual int, predicted int")
    cm = {(r.actual, r.predicted): r["count"] for r in metrics.confusion(df, "actual", "predicted").collect()}
    assert len(cm) == 9 and cm[(1, 2)] == 1 and cm[(2, 2)] == 0


def test_na_csv(spark):
    from sparkprep.sources.tables import read_table
    d = tempfile.mkdtemp(prefix="sparkprep-csv-")
    p = os.path.join(d, "x.csv")
    with open(p, "w") as fh:
        fh.write("a,a,d,n,,m\n1,2,2023-01-05,NA,5,null\n2,3,2023-02-05,3,,n/a\n")
    df = read_table(spark, p, "csv")
    assert df.columns == ["a", "a.1", "d", "n", "Unnamed: 4", "m"]
    rows = df.orderBy("a").collect()
    assert [r.n for r in rows] == [None, 3]
    assert [r.m for r in rows] == [None, None]
    assert dict(df.dtypes)["d"] == "string"


def test_profile_and_overview(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (1, "x", 1.0), (2, None, float("nan"))], "a long, b string, c double")
    p = {r.feature: r for r in profile.profile(df).collect()}
    assert p["b"].null_count == 1 and p["c"].null_count == 1 and p["a"].unique_count == 2
    assert p["b"].sample_value == "x" and p["c"].dtype == "float64"
    o = profile.overview(df).collect()[0]
    assert (o.rows, o.columns, o.missing, o.duplicates) == (3, 3, 2, 1)
