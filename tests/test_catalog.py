"""Every registered query runs on the smoke tables; selected ones match DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from sparkprep.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
ORACLE_SAMPLE = ["coerce_price", "classify_dirty_numeric", "title_case_priority", "sentinel_mask", "mode_fill",
                 "median_fill", "ffill_events_by_user", "bfill_events", "iqr_flags", "cap_all", "profile_orders",
                 "describe_lineitem", "corr_pearson", "corr_spearman", "knn_impute_part", "knn_classify",
                 "label_encode", "feature_plan", "clf_metrics_macro", "auc", "confusion", "split_stratified",
                 "manual_clean_orders", "hist_before_after", "stream_clean_events", "csv_roundtrip",
                 "iqr_flags_extreme", "cap_extreme", "ffill_nan", "ffill_text_order", "manual_clean_bfill",
                 "csv_roundtrip_documents", "label_encode_wide", "onehot_wide", "significant_pairs_linked"]


def _norm(rows):
    return sorted(tuple("∅" if v is None else (round(v, 6) if isinstance(v, float) else str(v)) for v in r)
                  for r in rows)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 2 and df.columns[0] == "feature"


def test_every_sql_key_has_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = entry.queries()[name](spark, SF)
    cols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(dcols)
    idx = [dcols.index(c) for c in cols]
    drows = [tuple(r[i] for i in idx) for r in res.fetchall()]
    assert _norm(srows) == _norm(drows)


def test_csv_documents_keep_every_row_and_character(spark, tmp_path):
    from sparkprep.catalog import q_csv_documents

    texts = ["  indented\n    code", "ends in a line break\n", "\n", " ", "", None, "a\rb", "a\r\n", 'q"', '"', "\\", "a,b", "NA", "\ttab\t"]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    back = q_csv_documents(spark, str(tmp_path))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
