"""Cached sources, scatter data, prediction files, guards, scoring on a stream, stages that are written once."""

import shutil

import pytest
from pyspark.sql import functions as F

from sparkprep.operators import clean, correlate
from sparkprep.plans.cleaning import AutoClean
from sparkprep.plans.training import ModelTrainer
from sparkprep.session import materialize, observed
from sparkprep.sources.cache import cached
from sparkprep.sources.tables import read_table
from sparkprep.streaming.apply import ScoringPlan, run_to_table


def rows(spark, n=200):
    return spark.createDataFrame([(i, f"c{i % 6}", float(i % 13), float(i % 7) * 2 + i % 13) for i in range(n)],
                                 "id long, s string, a double, y double")


def test_cache_reads_once_and_lets_go(spark, tmp_path):
    path = tmp_path / "t"
    rows(spark).write.parquet(str(path))
    source = cached(spark.read.parquet(str(path)))
    with source as df:
        assert source.fill() == 200 and source.held and 1000 < source.size_bytes() < 10 ** 6
        shutil.rmtree(path)                                   # a second scan would fail
        assert df.agg(F.sum("a")).first()[0] == sum(i % 13 for i in range(200))
    assert not source.held and source.size_bytes() is None
    assert not [v for v in spark.catalog.listTables() if v.name.startswith("cached_")]


def test_stage_is_run_once_and_keeps_any_name(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        calls.add(1)
        return x

    df = spark.range(50).select(counted("id").alias("a b;c"), F.lit(None).alias("A.b"), F.array(F.lit(1)).alias("x"))
    out = materialize(df)
    assert calls.value == 50 and out.columns == ["a b;c", "A.b", "x"] and out.count() == 50 and calls.value == 50


def test_observed_counts_come_with_the_write(spark):
    df, seen = observed(spark.range(30), n=F.count(F.lit(1)), odd=F.count_if(F.col("id") % 2 == 1))
    kept, left = observed(df.where("id < 10"), n=F.count(F.lit(1)))
    materialize(kept)
    assert seen.get == {"n": 30, "odd": 15} and left.get == {"n": 10}


def test_auto_clean_reads_its_input_once(spark):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        reads.add(1)
        return x

    base = spark.createDataFrame([(i % 40, f"Rs. {i % 40}", "ab"[i % 2] if i % 40 != 7 else None, float(i % 40)) for i in range(80)],
                                 "id long, p string, c string, v double")
    out, log = AutoClean(key="id").run(base.withColumn("p", counted("p")))
    assert out.count() == 40 and reads.value == 80
    entries = {(s, m): v for _, s, _, m, v in log.entries}
    assert entries["dedupe", "removed"] == "40" and entries["impute", "missing_before"] == "1"
    nothing, log = AutoClean(key="id").run(base.where("id < 0"))
    assert nothing.count() == 0 and log.entries[0][-1] == "0"


def test_counted_distinct(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (1, None), (2, "y")], "a long, b string")
    assert sorted(map(repr, clean.counted_distinct(df, "n").collect())) == sorted(
        ["Row(a=1, b='x', n=2)", "Row(a=1, b=None, n=2)", "Row(a=2, b='y', n=1)"])


def test_scatter(spark):
    df = spark.range(5000).select("id", (F.col("id") % 100).cast("double").alias("x"),
                                  F.when(F.col("id") % 10 == 3, F.lit(None)).otherwise(F.col("id") * 2.0).alias("y"),
                                  (F.col("id") % 3).alias("g"))
    cells = correlate.scatter_bins(df, "x", "y", "g", bins=10).collect()
    assert sum(r.n for r in cells) == 4500 and len(cells) <= 300 and {r.x_bin for r in cells} == set(range(10))
    first = sorted(map(tuple, correlate.scatter_sample(df, "id", "x", "y", "g", 20).collect()))
    assert len(first) == 60 and first == sorted(map(tuple, correlate.scatter_sample(df.repartition(9), "id", "x", "y", "g", 20).collect()))
    assert all(r[3] is not None for r in first)
    flat = spark.createDataFrame([(1, 5.0, 5.0), (2, 5.0, 7.0)], "id long, x double, y double")
    assert sorted(map(tuple, correlate.scatter_bins(flat, "x", "y", bins=4).collect())) == [(0, 0, 1), (0, 3, 1)]
    assert correlate.scatter_bins(flat.limit(0), "x", "y").count() == 0


def test_guard_presets_and_prediction_files(spark, tmp_path):
    tr = ModelTrainer(target="y", key="id", problem="regression", test_ratio="90/10", models=["Linear Regression", "Decision Tree"])
    assert tr.ready(rows(spark)) == {"problem": "regression", "rows": 200, "train": 180, "test": 20}
    with pytest.raises(ValueError, match="20 complete rows"):
        tr.ready(rows(spark, 19))
    with pytest.raises(KeyError):
        ModelTrainer(target="y", key="id", test_ratio="50/50")
    prep = tr.prepare(rows(spark))
    paths = tr.write_predictions(prep, tr.train(prep), str(tmp_path))
    assert sorted(p.rsplit("/", 1)[1] for p in paths.values()) == ["predictions_Decision_Tree", "predictions_Linear_Regression"]
    back = read_table(spark, paths["Decision Tree"], "csv")
    assert back.columns == ["id", "actual", "s", "a", "prediction"] and back.count() == prep.n_test
    prep.release()


@pytest.mark.parametrize("model", ["Decision Tree", "Gradient Boosted Trees"])
def test_stream_scores_like_the_batch_and_resumes(spark, tmp_path, model):
    from sparkprep.operators.models import Sizes
    df = rows(spark)
    tr = ModelTrainer(target="y", key="id", problem="regression", scaler="minmax", models=[model], sizes=Sizes(rounds=3, boost_depth=2))
    prep = tr.prepare(df)
    plan = ScoringPlan(encoder=prep.encoder, model=tr.train(prep)[model])
    asked = df.drop("y")
    want = sorted(map(tuple, plan.apply(asked).select("id", "s", "a", "prediction").collect()))
    folder, name = str(tmp_path / "in"), f"resumed_{model[:3]}_{tmp_path.name}"

    def drain():
        stream = spark.readStream.schema(asked.schema).parquet(folder)
        return run_to_table(plan.apply(stream).select("id", "s", "a", "prediction"), name)

    asked.where("id < 120").write.parquet(folder)
    assert drain().count() == 120
    asked.where("id >= 120").write.mode("append").parquet(folder)
    assert sorted(map(tuple, drain().collect())) == want                  # the second run took the new files alone
    with pytest.raises(ValueError, match="k-NN"):
        tr.models = ["KNN Regressor"]
        ScoringPlan(model=tr.train(prep)["KNN Regressor"])
    prep.release()
