"""Reproducible splits: stratified folds and an exact shuffle split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import keys, ranks


def stratified_folds(
    df: DataFrame,
    id_col: str,
    y: str,
    n_splits: int = 5,
    n_repeats: int = 1,
    seed: int = 123,
) -> DataFrame:
    """Rows with ``repeat`` and ``fold``; class shares per fold are kept to one row.

    The shuffle is the order of md5(seed:repeat:id) within a class.
    """
    repeats = F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1)))
    drawn = df.withColumn("repeat", repeats).withColumn(
        "draw", keys.digest(seed, "repeat", id_col)
    )
    ranked = ranks.hash_rank(drawn, "draw", id_col, ["repeat", y])
    fold = F.pmod(F.col("rank") - 1, F.lit(n_splits)).cast("int")
    return ranked.withColumn("fold", fold).drop("draw", "rank")


def shuffle_split(df: DataFrame, id_col: str, fraction: float = 0.7, seed: int = 0) -> DataFrame:
    """Rows with ``subset``: the first ``int(fraction * n)`` rows of a shuffle train."""
    n_train = int(fraction * df.count())
    ranked = ranks.hash_rank(df.withColumn("draw", keys.digest(seed, id_col)), "draw", id_col)
    subset = F.when(F.col("rank") <= n_train, F.lit("train")).otherwise(F.lit("valid"))
    return ranked.withColumn("subset", subset).drop("draw", "rank")


def fold_summary(fold_metrics: DataFrame) -> DataFrame:
    """Mean and population standard deviation of the fold AUCs per classifier."""
    return fold_metrics.groupBy("classifier").agg(
        F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc")
    )
