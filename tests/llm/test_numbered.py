"""Numbers of rows: the same in every scan, whatever the columns are called."""

import pytest
from pyspark.sql import functions as F

from gleaner.llm import near_dup, source_mix, words


@pytest.fixture(scope="module")
def clashing(docs, tmp_path_factory):
    """A table of files whose columns are called like those the operators make."""
    path = str(tmp_path_factory.mktemp("numbered") / "documents.parquet")
    for name in ("_row", "_metadata", "file", "first", "_drawn", "drawn"):
        docs = docs.withColumn(name, F.lit("mine"))
    docs.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _unique(table, name):
    found = table.select(F.count("*").alias("n"), F.countDistinct(name).alias("m")).first()
    return found.n == found.m


def test_rows_of_files_are_numbered_by_place(spark, clashing):
    name = words.free_name(clashing.columns, "row")
    numbered = words.numbered(clashing, name)
    assert numbered.columns == [*clashing.columns, name]
    assert numbered.count() == clashing.count() and _unique(numbered, name)
    read_anew = words.numbered(spark.read.parquet(clashing.inputFiles()[0].rsplit("/", 1)[0]), name).repartition(3)
    keys = [name, "doc_id", "text"]
    assert numbered.select(keys).exceptAll(read_anew.select(keys)).isEmpty()


def test_other_tables_are_numbered_too(docs, no_docs, clashing):
    for table in (docs, clashing.unionAll(clashing), clashing.join(clashing.select("doc_id"), "doc_id")):
        numbered = words.numbered(table, "number")
        assert numbered.count() == table.count() and _unique(numbered, "number")
    assert words.numbered(no_docs, "number").isEmpty()


def test_operators_keep_columns_of_the_same_name(docs, clashing):
    key = ["doc_id", "text"]
    kept = near_dup.survivors(clashing)
    assert kept.columns == clashing.columns
    assert kept.where("_row = 'mine' and _drawn = 'mine' and row = 7").count() == near_dup.survivors(docs).count()
    mixed = source_mix.mixed_documents(clashing)
    assert mixed.columns == clashing.columns and mixed.where("_row <> 'mine' or row <> 7").isEmpty()
    assert not mixed.select(key).isEmpty()
