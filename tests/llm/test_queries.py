"""Each registered query against its equivalent SQL, or against what can be checked without."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gleaner.llm import oracles, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    cursor = con.execute(oracles.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    expected = sorted(map(str, cursor.fetchall()))
    got = queries.QUERIES[name](spark, SF_DIR)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in got.select(columns).collect()) == expected


def test_every_document_is_predicted(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = queries.op6_language_id(spark, "/root/testdata/sf0.01")
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = out.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")))
    assert right.first()[0] > 0.98
    assert queries.op4_html_extraction(spark, SF_DIR).count() == spark.read.parquet(f"{SF_DIR}/pages.parquet").count()
    assert queries.op5_source_mix(spark, SF_DIR).count() == docs.count()
    scores = queries.op1_pitman_yor_lm(spark, SF_DIR)
    assert scores.count() == docs.count()
    assert {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"} <= set(scores.columns)
