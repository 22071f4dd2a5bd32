"""Scalar expressions on the hand-made fixtures."""

from pyspark.sql import functions as F

from sparkprep.functions import coerce_currency_number, skew_label, title_case
from sparkprep.operators import clean


def test_currency(spark):
    vals = ["Rs. 1,200", "PKR1,000", "$-3", "€5.", "rs 5", "12d", "unknown", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, price string")
    got = [r.p for r in df.select(coerce_currency_number("price").alias("p")).orderBy(F.lit(1)).collect()]
    got = [r.p for r in df.orderBy("id").select(coerce_currency_number("price").alias("p")).collect()]
    assert got == [1200.0, 1000.0, -3.0, 5.0, None, None, None, None]


def test_dirty_threshold(spark):
    rows = [(i, "1" if i < 2 else "x", "2" if i == 0 else "y") for i in range(20)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    fit = clean.classify_dirty_numerics(df.drop("id"))
    assert fit.dirty == ["a"] and fit.categorical == ["b"]
    out = clean.convert_columns(df, fit.dirty)
    assert dict(out.dtypes)["a"] == "double" and dict(out.dtypes)["b"] == "string"


def test_title_case(spark):
    vals = ["o'neil", "new-york", "HELLO world", "x1y", "a_b", "3rd st", "éCOLE d'été", None]
    want = ["O'Neil", "New-York", "Hello World", "X1Y", "A_B", "3Rd St", "École D'Été", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, s string")
    got = [r.t for r in df.orderBy("id").select(title_case("s").alias("t")).collect()]
    assert got == want
    assert want[:-1] == [v.title().strip() for v in vals[:-1]]


def test_title_case_idempotent(spark):
    df = spark.createDataFrame([("o'neil",), ("new-york",), ("3rd st",)], "s string")
    once = df.select(title_case("s").alias("s"))
    twice = once.select(title_case("s").alias("s"))
    assert sorted(once.collect()) == sorted(twice.collect())


def test_skew_label(spark):
    df = spark.createDataFrame([(0.2,), (-0.7,), (1.5,), (None,)], "s double")
    got = [r.l for r in df.select(skew_label("s").alias("l")).collect()]
    assert got == ["Symmetric", "Moderate Skew", "High Skew", None]
