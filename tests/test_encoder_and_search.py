"""The feature encoder as a pipeline stage, and the hyperparameter search built on it."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from sparkprep.operators import boosting, encode, metrics
from sparkprep.operators.split import hash_unit
from sparkprep.plans import search
from sparkprep.plans.features import FeatureEncoder, FeatureEncoderModel
from sparkprep.plans.training import ModelTrainer


def rows(spark, n=120):
    data = [(i, "abcd"[i % 4] if i % 9 else None, f"v{i % 7}", float(i), "xyz"[(i // 5) % 3]) for i in range(n)]
    return spark.createDataFrame(data, "id long, s string, t string, v double, cls string")


@pytest.mark.parametrize("sparse", [False, True])
@pytest.mark.parametrize("small", [1000, 2])
def test_saved_encoder_gives_equal_rows(spark, tmp_path, monkeypatch, sparse, small):
    monkeypatch.setattr(encode, "SMALL_MAPPING", small)          # 2: mappings are tables
    df = rows(spark)
    train, other = df.where("id < 80"), df.where("id >= 60").withColumn("t", F.when(F.col("id") == 100, "new").otherwise(F.col("t")))
    enc = FeatureEncoder(labelCols=["t"], oneHotCols=["s"], sparse=sparse, scaler="standard", excludeCols=["id", "cls"], outputCol="x")
    model = Pipeline(stages=[enc]).fit(train)
    model.write().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    stage = loaded.stages[0]
    assert isinstance(stage, FeatureEncoderModel) and stage.uid == model.stages[0].uid
    want = sorted(map(repr, model.transform(other).collect()))
    assert sorted(map(repr, loaded.transform(other).collect())) == want and len(want) == 60
    names = ["t", "v", "s_onehot_0", "s_onehot_1", "s_onehot_2", "s_onehot_3"] if sparse else ["t", "v", "s_a", "s_b", "s_c", "s_d"]
    assert stage.slots == names
    assert {r.n for r in model.transform(other).select(F.size(vector_to_array("x")).alias("n")).collect()} == {6}
    enc.write().overwrite().save(str(tmp_path / "e"))
    again = FeatureEncoder.load(str(tmp_path / "e"))
    assert again.extractParamMap().__len__() == enc.extractParamMap().__len__() and again.getOrDefault("oneHotCols") == ["s"]


def test_one_hot_form_is_asked_for(spark, monkeypatch):
    monkeypatch.setattr(encode, "SMALL_MAPPING", 2)
    df = rows(spark)
    dense = encode.fit_onehot(df, ["s"])
    assert dense.apply(df).columns == ["id", "t", "v", "cls", "s_a", "s_b", "s_c", "s_d"] == ["id", "t", "v", "cls", *dense.new_columns]
    monkeypatch.setattr(encode, "SMALL_MAPPING", 1000)
    assert encode.fit_onehot(df, ["s"]).apply(df).collect() == dense.apply(df).collect()
    vector = encode.fit_onehot(df, ["s"], sparse=True).apply(df)
    got = {r.id: tuple(r.x) for r in vector.select("id", vector_to_array("s_onehot").alias("x")).collect()}
    want = {r.id: (r.s_a, r.s_b, r.s_c, r.s_d) for r in dense.apply(df).collect()}
    assert got == {k: tuple(map(float, v)) for k, v in want.items()}
    none = df.withColumn("s", F.lit(None).cast("string"))
    assert encode.fit_onehot(none, ["s"], sparse=True).apply(none).count() == 120


def test_unseen_classes_stay_in_the_test_rows(spark):
    df = rows(spark).drop("s").withColumn("cls", F.when(F.col("id") == 77, "rare").otherwise(F.col("cls")))
    for seed in range(1, 40):
        tr = ModelTrainer(target="cls", key="id", models=["Decision Tree"], seed=seed)
        if df.where("id = 77").select((hash_unit("id", seed) < int(16 ** 6 * 0.2)).alias("t")).first().t:
            break
    prep = tr.prepare(df)
    assert prep.n_train + prep.n_test == 120 and prep.labels == ["x", "y", "z"]
    trained = tr.train(prep)
    result = tr.results(prep, trained["Decision Tree"])
    assert result.count() == prep.n_test and result.where("actual = 'rare' AND prediction <> 'rare'").count() == 1
    assert tr.evaluate(prep, trained).first()["accuracy"] < 1
    prep.release()


@pytest.mark.parametrize("encoding,scaler", [("onehot", "minmax"), ("sparse", "standard")])
def test_trainer_encodes_and_scales_on_train(spark, encoding, scaler):
    tr = ModelTrainer(target="cls", key="id", encoding=encoding, scaler=scaler, models=["Decision Tree", "Logistic Regression"])
    prep = tr.prepare(rows(spark).drop("s"))
    trained = tr.train(prep)
    assert tr.log == [] and tr.evaluate(prep, trained).count() == 2
    names = [n for n, _ in trained["Decision Tree"].importances()]
    assert names == prep.slots and len(names) == 8
    top = prep.train.select(F.max(vector_to_array("features")[0])).first()[0]
    assert (top == 1.0) if scaler == "minmax" else (1 < top < 3)
    prep.release()


def test_draws_and_grid():
    space = {"b": search.Integers(1, 9), "a": search.LogUniform(1e-4, 1.0), "c": search.Choice(("p", "q")), "d": search.Uniform(2, 3)}
    first = search.draws(space, 200, 1)
    assert first == search.draws(dict(reversed(space.items())), 200, 1) != search.draws(space, 200, 2)
    assert all(1 <= d["b"] <= 9 and 1e-4 <= d["a"] <= 1 and d["c"] in "pq" and 2 <= d["d"] <= 3 for d in first)
    assert 60 < sum(d["a"] < 1e-2 for d in first) < 140                  # even over the exponents
    assert search.grid({"y": [1, 2], "x": ["a"]}) == [{"x": "a", "y": 1}, {"x": "a", "y": 2}]


def test_budgets_are_nested(spark):
    df = spark.range(2000)
    parts = [{r.id for r in df.where(search.in_budget("id", s)).collect()} for s in search.shares(3)]
    assert parts[0] < parts[1] < parts[2] and len(parts[2]) == 2000 and 150 < len(parts[0]) < 300
    table = search.budget_rows(df, "id").collect()
    assert len(table) == 9 and all(r.train_rows + r.held_out_rows == 2000 for r in table if r.rung == 2)


def test_halving_keeps_the_better_candidates(spark):
    df = rows(spark, 400).drop("s").withColumn("cls", F.when(F.col("v") % 40 < 13, "x").when(F.col("v") % 40 < 27, "y").otherwise("z"))
    df = df.withColumn("m", F.col("v") % 40)
    s = search.Search("cls", "id", "classification", lambda p: DecisionTreeClassifier(seed=1, **p), folds=2)
    best, log = s.run(df, [{"maxDepth": d} for d in (1, 1, 5, 1)], rungs=2)
    log = log.collect()
    assert best == {"maxDepth": 5} and [r.rung for r in log] == [0] * 4 + [1] * 2
    assert [r.candidate for r in log if r.kept] == [2, 0, 2]
    assert log[0].train_rows < log[-1].train_rows == 400 and log[-1].score < log[-2].score
    assert all(r.kept == (r.candidate == 2) for r in log if r.rung == 1)


def test_encoder_is_fitted_in_each_fold(spark):
    df = rows(spark, 90)
    s = search.Search("cls", "id", "classification", None, folds=3)
    for fold in range(3):
        one = df.withColumn("t", F.when(search.fold_of("id", 3) == fold, F.lit("only held out")).otherwise(F.col("t")))
        train, held, width, classes = s._fold(one.drop("s"), fold, 1.0)
        codes = {r.x[0] for r in held.select(vector_to_array("features").alias("x")).collect()}
        assert codes == {7.0} and train.count() + held.count() == 90 and (width, classes) == (2, 3)


def test_search_for_a_number_and_boosting(spark):
    df = spark.createDataFrame([(i, float(i % 10), float((i % 10) ** 2)) for i in range(200)], "id long, a double, y double")
    s = search.Search("y", "id", "regression", lambda p: DecisionTreeRegressor(seed=1, **p), folds=2, metric="rmse")
    assert s.run(df, search.grid({"maxDepth": [1, 6]}))[0] == {"maxDepth": 6}
    b = search.Search("y", "id", "regression", lambda p: boosting.Settings(rounds=p["rounds"], depth=2), folds=2)
    assert b.run(df, search.grid({"rounds": [1, 8]}))[0] == {"rounds": 8}


def test_metrics_of_many_classes_send_no_grid(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("a"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string"))
                                  .otherwise(F.lit("none")).alias("p"))
    m = metrics.classification_metrics(df, "a", "p").first()
    assert m.accuracy == 0.5 and m.recall == round(2500 / 5001, 4)
    with pytest.raises(ValueError, match="classes"):
        metrics.confusion(df, "a", "p")
    assert metrics.confusion_counts(df, "a", "p").count() == 5000


def test_place_of_one_needs_no_dense_vector(spark):
    from pyspark.ml.linalg import SparseVector, VectorUDT
    from pyspark.sql import types as T
    far = 2_000_000_000                                     # a dense copy would take 16 GB
    rows = [(0, SparseVector(far, [far - 1], [1.0])), (1, SparseVector(far, [0], [1.0])), (2, SparseVector(far, [], [])), (3, None)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("id", T.IntegerType()), T.StructField("x", VectorUDT())]))
    got = df.select("id", encode.place_of_one("x").alias("place")).collect()
    assert {r.id: r.place for r in got} == {0: far - 1, 1: 0, 2: -1, 3: None}


def test_wide_onehot_makes_no_dense_vector(spark):
    from sparkprep import catalog
    hot = catalog.QUERIES["onehot_wide"](spark, "/root/testdata/sf0.001")
    assert "vector_to_array" not in hot._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "UDF(name_onehot" not in hot._jdf.queryExecution().optimizedPlan().toString()
