import __spark_entry__
import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import words
from sparkprep.llm import lines, queries

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_every_operator_has_a_query():
    found = __spark_entry__.queries()
    assert all(sum(k.startswith(f"op{n}_") for k in found) == 1 for n in range(1, 11)) and "pipeline" in found
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_stages_on_planted_cases(spark, tmp_path):
    item = words(30, 5)
    clean = {i: "\n".join(words(20, 60 * i + k).capitalize() + "." for k in range(4)) for i in range(40)}
    docs = dict(clean)
    docs[100] = clean[0]                                                  # copy
    docs[101] = clean[1] + "\n" + item                                    # benchmark passage
    docs[102] = " ".join(w + "%%%" for w in clean[2].split())             # junk
    docs[103] = words(60, 7777) + "\n" + clean[3].split("\n")[0]          # a line of another document
    docs[104] = None
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        if i < 4:
            assert out.columns == frame.columns and out.dtypes == frame.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r[0] for r in frame.select("doc_id").distinct().collect()}
    assert 102 not in seen["quality_classifier"] and set(clean) <= seen["quality_classifier"]
    cut = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/fuzzy_line_dedup").collect()}
    assert cut[100].text == "" and cut[103].text == docs[103].split("\n")[0] and cut[5].text == clean[5]
    assert all(r.n_chars == len(r.text or "") for r in cut.values() if r.text is not None)
    left = [lines.normal(x) for r in cut.values() for x in (r.text or "").split("\n") if lines.normal(x)]
    assert len(left) == len(set(left))
    assert {100, 104} & seen["simhash_near_dedup"] in ({100}, {104}, set()) and set(clean) <= seen["simhash_near_dedup"]
    assert 101 not in seen["benchmark_decontamination"] and set(clean) <= seen["benchmark_decontamination"]
    assert seen["vector_packing"] == seen["benchmark_decontamination"]
    whole = corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0]
    assert whole == frame.agg(F.sum("length")).first()[0]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twins(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    found = queries.QUERIES[name](spark, folder)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, found.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
