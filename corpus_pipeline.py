"""A corpus from raw documents to packed training sequences, stage by stage.

Every stage reads all rows its predecessor kept. All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import exact_dedup, language_id, near_dup, packing, source_mix, words
from gleaner.session import ship_package, staged

#: Least share of a text's n-grams that its language must contain.
MIN_LANGUAGE_SCORE = 0.3

#: No single statement of SQL can express the stages.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or in none of the labelled languages."""
    ship_package(spark)
    model = language_id.fit(docs)
    # The prediction must not replace a column of the documents.
    name = words.free_name(docs.columns, "found")
    found = language_id.detected(docs, model, name)
    known = (F.col(f"{name}.lang_pred") != language_id.UNDETERMINED) & (F.col(f"{name}.score") >= MIN_LANGUAGE_SCORE)
    return found.where(known).drop(name)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts stays, the one with the largest id."""
    ship_package(spark)
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group that shares four fifths of its five-word shingles stays."""
    ship_package(spark)
    return near_dup.survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text is drawn from the sources by weight; a row per document and round."""
    ship_package(spark)
    return source_mix.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of a document with its place in a sequence of 2048 tokens."""
    ship_package(spark)
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(docs, packing.PackingParams(tokenizer))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dup", drop_near_copies),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
