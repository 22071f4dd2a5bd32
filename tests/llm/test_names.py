"""Columns named like the operators' own helper columns travel through the filtering operators."""

import pytest
from conftest import words
from pyspark.sql import functions as F

from sparkprep.llm import decontaminate, quality, simhash

ITEM = words(40, 99)


@pytest.mark.parametrize("keep", [
    lambda d, s: simhash.keep_one(d), lambda d, s: quality.keep_good(d),
    lambda d, s: decontaminate.drop_contaminated(d, s.createDataFrame([(1, ITEM)], "item_id long, text string"))],
    ids=["simhash", "quality", "decontaminate"])
def test_helper_names(spark, keep):
    texts = [words(60, i) for i in range(8)] + [words(60, 1), "before " + ITEM + " after"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    names = ["__gone", "__first", "row_key", "key", "id", "component", "fp"]
    wide = df.select("*", *[F.lit(n).alias(n) for n in names])
    out = keep(wide, spark)
    assert out.columns == wide.columns
    rows = out.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in keep(df, spark).collect()}
    assert all(r[n] == n for r in rows for n in names)
