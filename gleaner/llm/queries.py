"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import (
    ball_kmeans,
    cover_search,
    exact_dedup,
    fill_middle,
    html_text,
    language_id,
    near_dup,
    packing,
    pitman_yor,
    quality,
    source_mix,
    substring_dedup,
    toxic_spans,
    words,
)
from gleaner.session import staged

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _in_bucket(bucket: int, n: int) -> Column:
    """Whether crc32 of the id modulo ``n`` is ``bucket``; false for a null id."""
    return F.coalesce(words.id_bucket("doc_id", n) == bucket, F.lit(False))


def op1_pitman_yor_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every document, learned from four fifths of them."""
    held_out = _in_bucket(1, 5)
    docs = _documents(spark, sf_dir).select("doc_id", "text", held_out.alias("held_out"))
    docs = docs.withColumn("learn", ~F.col("held_out") & F.col("doc_id").isNotNull())
    model = pitman_yor.fit(docs)
    scored = pitman_yor.score(docs.drop("learn"), model)
    return scored.withColumn("train_tokens", F.lit(model.train_tokens).cast("long"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 2048 tokens."""
    params = packing.PackingParams(public_tokenizers.path(TOKENIZER))
    return packing.pack(_documents(spark, sf_dir), params)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest id of each stays."""
    return exact_dedup.dedup(_documents(spark, sf_dir))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix by weights 1, 2, 3 takes of every document."""
    documents, _ = source_mix.mix(_documents(spark, sf_dir))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of them."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = docs.withColumn("held_out", _in_bucket(0, 5))
    model = language_id.fit(held_out.where("not held_out and doc_id is not null"))
    found = language_id.predict(held_out.select("doc_id", "held_out", "text"), model)
    return found.drop("text")


def op7_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share four fifths of their two-word shingles."""
    params = near_dup.NearDupParams(shingle=2, threshold_percent=80)
    return near_dup.group(_documents(spark, sf_dir), params=params).drop("row")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated passages of 35 words."""
    left = substring_dedup.remove_repeats(_documents(spark, sf_dir))
    return left.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")


def op9_cover_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows by inner product for every hundredth vector."""
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return cover_search.top_k(embeddings, F.col("vec_id") % 100 == 0)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from two thirds of the labels.

    A document with labels that disagree is left out of the fit.
    """
    docs = _documents(spark, sf_dir).select("doc_id", _in_bucket(1, 3).alias("held_out"), "text")
    rows = staged(quality.described(docs), "statistics")
    labels = (
        spark.read.parquet(f"{sf_dir}/labels.parquet")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
        .where("label = other")
    )
    model = quality.fit(rows.where("not held_out").join(labels, "doc_id"))
    return quality.predict(rows, model)


def op11_ball_kmeans_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector, its error and that of its label."""
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ball_kmeans.described(ball_kmeans.compress(embeddings))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut in three and put together anew, by digests."""
    return fill_middle.described(fill_middle.transform(_documents(spark, sf_dir)))


def op13_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from two thirds of the labels.

    A document with labels that disagree is left out of the fit.
    """
    docs = _documents(spark, sf_dir).select("doc_id", _in_bucket(1, 3).alias("held_out"), "text")
    labels = (
        spark.read.parquet(f"{sf_dir}/labels.parquet")
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
        .where("toxic = other")
    )
    model = toxic_spans.fit(docs.where("not held_out").join(labels, "doc_id"), "doc_id", "text", "toxic")
    return toxic_spans.predict(docs, model)


QUERIES: dict[str, Query] = {
    "op1_pitman_yor_lm": op1_pitman_yor_lm,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_source_mix": op5_source_mix,
    "op6_language_id": op6_language_id,
    "op7_minhash_near_dup": op7_minhash_near_dup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_cover_tree_search": op9_cover_tree_search,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_ball_kmeans_codes": op11_ball_kmeans_codes,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_toxic_spans": op13_toxic_spans,
    "pipeline": corpus_pipeline.run,
}
