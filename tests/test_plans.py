"""Plan checks: no single-partition exchange over data rows, no Python UDF,
no cartesian product in the scalable operators."""

from sparkprep import catalog
from sparkprep.operators import impute, order
from sparkprep.sources import dirt

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fill_has_no_single_partition(spark):
    e = dirt.gappy_events(spark, SF)
    for df in (impute.ffill(e, "event_id"), impute.bfill(e, "event_id", "user_id")):
        text = plan(df)
        assert "SinglePartition" not in text
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_ranks_have_no_single_partition(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet")
    r = order.average_ranks(li.select("l_extendedprice"), "l_extendedprice")
    assert "SinglePartition" not in plan(r)


def test_no_python_udf_or_cartesian(spark):
    for name in ("coerce_price", "title_case_priority", "mode_fill", "iqr_flags", "ffill_events_by_user",
                 "label_encode", "minmax_scale", "split_stratified"):
        text = plan(catalog.QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text, name
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name


def test_scan_prunes_columns(spark):
    text = catalog.QUERIES["coerce_price"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_custkey" not in text.split("ReadSchema")[-1].split("\n")[0]


def test_knn_join_is_not_cartesian(spark):
    text = plan(catalog.QUERIES["knn_impute_part"](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
