"""The data side of a labeling session: which items next, and how it is going."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import keys
from gleaner.operators import metrics

# Default focus range and the weight outside of it.
FOCUS_LOW = 0.15
FOCUS_HIGH = 0.85
OUTSIDE_WEIGHT = 0.01


def sampling_weight(p: str, lo: float = FOCUS_LOW, hi: float = FOCUS_HIGH) -> Column:
    """1 inside [lo, hi], times 0.01 for each side the score is beyond."""
    below = F.when(F.col(p) < lo, F.lit(OUTSIDE_WEIGHT)).otherwise(F.lit(1.0))
    above = F.when(F.col(p) > hi, F.lit(OUTSIDE_WEIGHT)).otherwise(F.lit(1.0))
    return below * above


def uncertainty_sample(
    scores: DataFrame,
    labels: DataFrame,
    k: int,
    lo: float = FOCUS_LOW,
    hi: float = FOCUS_HIGH,
    seed: int = 0,
    id_col: str = "sample_id",
    p: str = "p",
) -> DataFrame:
    """Draw ``k`` unlabeled items, weighted towards uncertain scores, without replacement.

    Exponential keys ``-ln(u) / weight`` (Efraimidis and Spirakis): the k smallest are a
    weighted sample. Only k rows per task travel.
    """
    unlabeled = scores.join(labels.select(id_col), id_col, "left_anti")
    weight = sampling_weight(p, lo, hi)
    return (
        unlabeled.withColumn("weight", weight)
        .withColumn("draw", -F.log(keys.uniform(seed, id_col)) / F.col("weight"))
        .orderBy("draw", id_col)
        .limit(k)
    )


def sort_by_score(scores: DataFrame, p: str = "p", id_col: str = "sample_id") -> DataFrame:
    """Ascending score order, ids breaking ties."""
    return scores.orderBy(p, id_col)


def first_labels(events: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """The first label every item received in a session."""
    return events.groupBy(id_col).agg(
        F.min_by("label", F.struct("ts", "event_id")).alias("label")
    )


def label_progress(scores: DataFrame, labels: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Unlabeled, labeled, positive and negative items of the pool."""
    marked = scores.select(id_col).join(labels.select(id_col, "label"), id_col, "left")
    return marked.agg(
        F.count_if(F.col("label").isNull()).alias("unlabeled"),
        F.count("label").alias("labeled"),
        F.count_if(F.col("label") == 1).alias("positive"),
        F.count_if(F.col("label") == 0).alias("negative"),
    )


def session_eval(
    labels: DataFrame, scores: DataFrame, id_col: str = "sample_id", p: str = "p"
) -> DataFrame:
    """Accuracy, AUC and size of the session; all 0 unless both classes were labeled."""
    judged = labels.select(id_col, "label").join(scores.select(id_col, p), id_col)
    return summarize_session(judged, p)


def summarize_session(judged: DataFrame, p: str = "p") -> DataFrame:
    counted = judged.withColumn("session", F.lit(0)).groupBy("session").agg(
        F.avg(metrics._hit(p, "label")).alias("accuracy"), F.count("*").alias("n")
    )
    area = metrics.auc(judged.withColumn("session", F.lit(0)), p, "label", ["session"])
    return (
        counted.join(area, "session")
        .where(F.col("auc").isNotNull())
        .agg(
            F.coalesce(F.max("accuracy"), F.lit(0.0)).alias("accuracy"),
            F.coalesce(F.max("auc"), F.lit(0.0)).alias("auc"),
            F.coalesce(F.max("n"), F.lit(0)).alias("n"),
        )
    )
