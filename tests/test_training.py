"""Training plan: every model, probabilities, splits and keys."""

import pytest
from pyspark.sql import functions as F

from sparkprep.operators import neighbors, order, split
from sparkprep.operators.correlate import t_two_sided_p
from sparkprep.operators.models import Sizes
from sparkprep.plans.training import ModelTrainer

SMALL = Sizes(iterations=20, trees=5, depth=4, rounds=3, svm_iterations=5, fourier=16)


def labelled(spark, n=240):
    rows = [(i, float(i % 17), float((i * 7) % 11), "xyz"[(i % 17) // 6], float(i % 17) * 2 + (i * 7) % 11) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, cls string, y double")


def test_every_classifier_scores_and_has_auc(spark):
    tr = ModelTrainer(target="cls", key="id", sizes=SMALL)
    prep = tr.prepare(labelled(spark).drop("y"))
    assert prep.labels == ["x", "y", "z"]
    trained = tr.train(prep)
    assert tr.log == [] and len(trained) == 6
    rows = {r["model"]: r for r in tr.evaluate(prep, trained).collect()}
    assert all(r["auc"] is not None for r in rows.values()), (rows, tr.log)
    shares = trained["KNN"].predict(prep.test).select("probs").collect()
    assert all(len(r.probs) == 3 and abs(sum(r.probs) - 1) < 1e-9 for r in shares)
    probs = trained["Decision Tree"].predict(prep.test).select(F.size("probs").alias("n")).distinct().collect()
    assert [r.n for r in probs] == [3]                       # no class beside the three
    assert tr.results(prep, trained["KNN"]).where("confidence_pct IS NULL").count() == 0
    prep.release()


def test_every_regressor(spark):
    tr = ModelTrainer(target="y", key="id", problem="regression", sizes=SMALL)
    prep = tr.prepare(labelled(spark).drop("cls"))
    trained = tr.train(prep)
    rows = {r["model"]: r for r in tr.evaluate(prep, trained).collect()}
    assert len(rows) == 6 and rows["Linear Regression"]["r2"] > 0.999
    prep.release()


def test_keys_must_be_unique(spark):
    df = labelled(spark).withColumn("id", F.col("id") % 50)
    with pytest.raises(ValueError, match="repeats"):
        ModelTrainer(target="cls", key="id").prepare(df)


def test_class_of_one_row_falls_back_to_the_plain_split(spark):
    df = labelled(spark).withColumn("cls", F.when(F.col("id") == 3, F.lit("w")).otherwise(F.col("cls")))
    train, test = split.stratified_split(df, "id", "cls", 0.2, 42)
    plain = split.hash_split(df, "id", 0.2, 42)
    assert {r.id for r in test.collect()} == {r.id for r in plain[1].collect()}
    assert train.count() + test.count() == 240


def test_stratified_split_counts_null_as_a_class(spark):
    df = labelled(spark).withColumn("cls", F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("cls")))
    train, test = split.stratified_split(df, "id", "cls", 0.25, 7)
    sizes = {r.cls: r["count"] for r in df.groupBy("cls").count().collect()}
    got = {r.cls: r["count"] for r in test.groupBy("cls").count().collect()}
    assert got == {c: -(-n // 4) for c, n in sizes.items()} and train.count() + test.count() == 240


def test_nearest_of_a_far_query_and_one_column(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(30)] + [(99, None)], "id long, v double")
    filled = neighbors.knn_impute(df, "id", ["v"], 5).where("id = 99").first()
    assert filled.v == pytest.approx(14.5)                   # shares no coordinate with any row: the mean
    rows = [(i, [float(i % 5), float(i % 3)], i % 2) for i in range(60)]
    train = spark.createDataFrame(rows, "id long, x array<double>, y int")
    far = spark.createDataFrame([(1000, [1e13, -1e13]), (1001, None)], "id long, x array<double>")
    found = neighbors.knn_predict(train, far, "id", "x", "y").select("id", "prediction").collect()
    near = sorted((((1e13 - x[0]) ** 2 + (-1e13 - x[1]) ** 2) ** 0.5, i, y) for i, x, y in rows)[:5]
    votes = [y for *_, y in near]
    assert [(r.id, r.prediction) for r in found] == [(1000, 0 if votes.count(0) >= 3 else 1)]


def test_many_cuts_place_like_few(spark):
    cuts = sorted({(i * 37) % 5000 for i in range(700)})
    df = spark.createDataFrame([(v,) for v in [None, -1, 0, 5000, *range(0, 5000, 13), *cuts]], "v int")
    got = df.select("v", order.bucket_of(F.col("v"), cuts).alias("b")).collect()
    assert all(r.b == (-1 if r.v is None else sum(c <= r.v for c in cuts)) for r in got)


def test_p_value_holds_for_any_number_of_rows():
    for df in (10 ** 6, 10 ** 9, 10 ** 13, 10 ** 15):
        assert t_two_sided_p(1.959963984540054, df) == pytest.approx(0.05, abs=1e-6)
    assert t_two_sided_p(12.706204736, 1) == pytest.approx(0.05, abs=1e-9)
    assert t_two_sided_p(0.0, 5) == pytest.approx(1.0)


def test_column_names_with_a_dot(spark):
    from sparkprep.operators import clean, impute, outliers, profile
    from sparkprep.operators.encode import fit_label_encoding, fit_onehot
    from sparkprep.operators.scale import fit_scaler
    rows = [(i, "u" if i % 3 else None, float(i) if i % 4 else -999.0, float(i * i)) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, `t.1` string, `a.1` double, `b.x` double")
    assert profile.profile(df).count() == 4
    masked = clean.mask_sentinels(df, ["a.1"], [-999])
    assert masked.where("`a.1` IS NULL").count() == 8
    assert impute.mode_fill(masked, ["t.1"])[0].where("`t.1` IS NULL").count() == 0
    assert impute.median_fill(masked, ["a.1"])[0].where("`a.1` IS NULL").count() == 0
    assert impute.ffill(masked, "id", cols=["a.1"]).where("`a.1` IS NULL").count() == 1
    assert outliers.iqr_flags(df, "b.x").where("is_outlier").count() == 0
    assert outliers.cap_all(df, ["b.x"])[0].columns == df.columns
    assert fit_label_encoding(df, ["t.1"]).apply(df).columns == df.columns
    assert "t.1_u" in fit_onehot(df, ["t.1"]).apply(df).columns
    assert fit_scaler(df, "standard", ["a.1", "b.x"]).apply(df).columns == df.columns
    assert impute.temporal_scores(df, ["t.1"]).count() == 1


def test_stratified_split_keeps_rows_with_a_null_key(spark):
    rows = [(None if i % 3 else i, "ab"[i % 2], i) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, cls string, n long").repartition(5)
    for ratio, wanted in ((0.25, 30), (0.9, 108), (0.0, 0)):
        train, test = split.stratified_split(df, "id", "cls", ratio, 7)
        tr, te = [r.n for r in train.collect()], [r.n for r in test.collect()]
        assert sorted(tr + te) == list(range(120)) and len(te) == wanted


@pytest.mark.parametrize("query", ["best_model", "model_compare_clf", "model_compare_reg"])
def test_a_failing_model_is_the_query_s_error(spark, tmp_path, monkeypatch, query):
    from sparkprep import catalog

    class Few(ModelTrainer):
        def __post_init__(self):
            super().__post_init__()
            self.models, self.sizes = ["Decision Tree", "Gradient Boosted Trees"], SMALL

    spark.range(120).select(F.col("id").alias("o_orderkey"), (F.col("id") * 1.5).alias("o_totalprice"), (F.col("id") % 9).alias("o_custkey"),
                            F.lit("1-URGENT").alias("o_orderpriority"), F.when(F.col("id") % 2 == 0, "F").otherwise("O").alias("o_orderstatus")
                            ).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(120).select(F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("id").alias("l_partkey"),
                            F.col("id").alias("l_suppkey"), F.lit("1995-01-01").alias("l_shipdate"),
                            (F.col("id") % 50).cast("double").alias("l_quantity"), F.lit(0.1).alias("l_discount"), F.lit(0.0).alias("l_tax"),
                            F.lit("N").alias("l_returnflag"), (F.col("id") * 2.5).alias("l_extendedprice")).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(catalog, "ModelTrainer", Few)
    fit = ModelTrainer._fit

    def failing(self, name, spec, prep):
        if name == "Gradient Boosted Trees":
            raise OSError("lost")
        return fit(self, name, spec, prep)

    monkeypatch.setattr(ModelTrainer, "_fit", failing)
    with pytest.raises(RuntimeError, match="Gradient Boosted Trees.*lost"):
        catalog.QUERIES[query](spark, str(tmp_path))
    monkeypatch.setattr(ModelTrainer, "_fit", fit)                  # nothing of the failure is kept
    rows = catalog.QUERIES[query](spark, str(tmp_path)).collect()
    assert len(rows) == (1 if query == "best_model" else 2)
