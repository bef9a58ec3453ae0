"""Gathering stored features into one normalised, concatenated vector per item."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import vectors
from gleaner.operators.featurize import feature_column


def item_feature_join(items: DataFrame, features: DataFrame, model: str) -> DataFrame:
    """Items with their stored vector of one model and the number of its vectors.

    An item without any has nulls. A stored row that is doubled does not double its item.
    """
    chosen = (
        features.where(F.col("model") == model)
        .groupBy("sample_id")
        .agg(F.first("vec").alias("vec"), F.count("*").alias("n_vectors"))
    )
    return items.join(chosen, "sample_id", "left")


def collect_features(
    items: DataFrame, features: DataFrame, model: str, normalize: bool = True
) -> DataFrame:
    """``(sample_id, vec)`` of one model for all items.

    An item without a vector, or with more than one, fails the job with an error naming the
    model; the check is part of the join, not a pass of its own. With ``normalize`` every
    vector has norm 1; a zero vector becomes null.
    """
    message = F.concat(
        F.when(F.col("n_vectors") > 1, F.lit("several")).otherwise(F.lit("no")),
        F.lit(f" features of model {model!r} for item "),
        F.col("sample_id").cast("string"),
    )
    found = item_feature_join(items.select("sample_id"), features, model)
    vec = F.when(F.col("n_vectors") == 1, F.col("vec")).otherwise(F.raise_error(message))
    checked = found.select("sample_id", vec.alias("vec"))
    return checked.withColumn("vec", vectors.l2_normalize("vec")) if normalize else checked


def misaligned_items(features: DataFrame, models: Sequence[str]) -> DataFrame:
    """Sample ids that do not have exactly one vector of every model."""
    wanted = features.where(F.col("model").isin(list(models)))
    return (
        wanted.groupBy("sample_id")
        .agg(F.count_distinct("model").alias("n_models"), F.count("*").alias("n_vectors"))
        .where((F.col("n_models") != len(models)) | (F.col("n_vectors") != len(models)))
    )


def check_alignment(features: DataFrame, models: Sequence[str]) -> None:
    """Refuse features whose models do not cover the same items."""
    wrong = misaligned_items(features, models).count()
    if wrong:
        raise ValueError(f"{wrong} items lack a vector of one of the models {list(models)}")


def concat_vectors(parts: Sequence[Column | str], normalize: bool = True) -> Column:
    """Concatenate model blocks, each normalised on its own.

    The dot product of a row with itself is then the number of blocks; a zero block
    makes the whole vector null.
    """
    blocks = [vectors.l2_normalize(p) if normalize else F.col(p) for p in parts]
    return F.concat(*blocks)


def concat_features(
    features: DataFrame, models: Sequence[str], normalize: bool = True, check: bool = True
) -> DataFrame:
    """``(sample_id, vec)``: one concatenated vector per item, blocks in list order.

    One shuffle by item whatever the number of models. With ``check`` an item that does
    not have exactly one vector of every model fails the job; without it such an item
    gets null.
    """
    blocks = [f"block_{i}" for i in range(len(models))]
    of_model = [F.when(F.col("model") == m, F.col("vec")) for m in models]
    wide = (
        features.where(F.col("model").isin(list(models)))
        .groupBy("sample_id")
        .agg(
            F.count("*").alias("n_vectors"),
            *[F.first(v, ignorenulls=True).alias(b) for v, b in zip(of_model, blocks)],
        )
    )
    vec = concat_vectors(blocks, normalize)
    if check:
        complete = F.col("n_vectors") == len(models)
        for block in blocks:
            complete = complete & F.col(block).isNotNull()
        message = F.concat(
            F.lit(f"not one vector of each of {list(models)} for item "),
            F.col("sample_id").cast("string"),
        )
        vec = F.when(complete, vec).otherwise(F.raise_error(message))
    return wide.select("sample_id", vec.alias("vec"))


def direct_features(
    items: DataFrame, models: Sequence[str], keep: Sequence[str] = (), normalize: bool = True
) -> DataFrame:
    """Concatenated vectors computed straight from the items, without a store or shuffle."""
    blocks = [f"block_{i}" for i in range(len(models))]
    wide = items.select(
        "sample_id", *keep, *[feature_column(m).alias(b) for m, b in zip(models, blocks)]
    )
    return wide.select("sample_id", *keep, concat_vectors(blocks, normalize).alias("vec"))


def width_range(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Smallest and largest vector width, rows and rows without a vector."""
    return df.agg(
        F.min(F.size(vec)).alias("min_width"),
        F.max(F.size(vec)).alias("max_width"),
        F.count("*").alias("n_items"),
        F.count_if(F.col(vec).isNull()).alias("n_null"),
    )


def checked_width(vec: Column | str, width: int) -> Column:
    """The vector itself; a vector of another width fails the job (null passes)."""
    vec = F.col(vec) if isinstance(vec, str) else vec
    message = F.concat(
        F.lit(f"expected vectors of width {width}, found "), F.size(vec).cast("string")
    )
    return F.when(vec.isNull() | (F.size(vec) == width), vec).otherwise(F.raise_error(message))


def check_same_models(scorer_models: Sequence[str], dedup_models: Sequence[str]) -> None:
    """Keep-best dedup needs the scorer's models, in the same order."""
    if list(scorer_models) != list(dedup_models):
        raise ValueError(
            f"scorer uses {list(scorer_models)}, duplicates are sought with {list(dedup_models)}"
        )
