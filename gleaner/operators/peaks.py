"""Thresholds read off the ratio curves: where a ratio comes closest to its target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO_TARGET = 30
# The tightest margins a search may report.
POSITIVE_FLOOR = 0.65
NEGATIVE_CEILING = 0.35


def peak_positions(heights: Column) -> Column:
    """Zero-based positions of the interior local maxima of an array, in order.

    One walk over the array: a rise starts a top, a fall after a rise ends it. A flat top
    gives its middle (rounded down); the ends of the array are never peaks.
    """
    nothing = F.struct(
        F.lit(None).cast("double").alias("previous"),
        F.lit(0).alias("at"),
        F.lit(0).alias("start"),
        F.lit(False).alias("rising"),
        F.array().cast("array<int>").alias("peaks"),
    )

    def step(state: Column, height: Column) -> Column:
        rises = F.coalesce(height > state.previous, F.lit(False))
        falls = F.coalesce(height < state.previous, F.lit(False))
        middle = F.floor((state.start + state["at"] - 1) / 2).cast("int")
        return F.struct(
            height.alias("previous"),
            (state["at"] + 1).alias("at"),
            F.when(rises, state["at"]).otherwise(state.start).alias("start"),
            F.when(rises, F.lit(True)).when(falls, F.lit(False)).otherwise(state.rising).alias(
                "rising"
            ),
            F.when(falls & state.rising, F.concat(state.peaks, F.array(middle)))
            .otherwise(state.peaks)
            .alias("peaks"),
        )

    return F.aggregate(heights, nothing, step, lambda state: state.peaks)


def _with_peaks(
    curves: DataFrame, ratios: Sequence[str], target: float, by: Sequence[str]
) -> DataFrame:
    """One row per curve: its points in order and the peaks of each named ratio.

    A curve has as many points as the sweep has thresholds, so it fits one row.
    """
    points = F.array_sort(F.collect_list(F.struct("k", "t", *ratios)))
    gathered = curves.groupBy(*by).agg(points.alias("points"))
    for ratio in ratios:
        heights = F.transform("points", lambda point: -F.abs(point[ratio] - target))
        gathered = gathered.withColumn(f"{ratio}_peaks", peak_positions(heights))
    return gathered


def curve_peaks(
    curves: DataFrame, ratio: str, target: float = RATIO_TARGET, by: Sequence[str] = ()
) -> DataFrame:
    """Interior local maxima ``k`` of ``-abs(ratio - target)`` per group."""
    return _with_peaks(curves, [ratio], target, by).select(
        *by, F.explode(f"{ratio}_peaks").alias("k")
    )


def ratio_peaks(
    curves: DataFrame, target: float = RATIO_TARGET, by: Sequence[str] = ()
) -> DataFrame:
    """Per group: first peak of the positives ratio, last peak of the negatives ratio.

    The thresholds ``t`` at these peaks are null where a curve has none.
    """
    found = _with_peaks(curves, ["positives_ratio", "negatives_ratio"], target, by)

    def threshold(position: Column) -> Column:
        return F.try_element_at("points", position + 1)["t"]

    first = F.try_element_at("positives_ratio_peaks", F.lit(1))
    last = F.try_element_at("negatives_ratio_peaks", F.lit(-1))
    return found.select(
        *by,
        threshold(first).alias("positive_threshold"),
        threshold(last).alias("negative_threshold"),
    )


def safe_margins(peaks: DataFrame) -> DataFrame:
    """Clamp the thresholds: positive at least 0.65, negative at most 0.35; null clamps too."""
    return peaks.withColumn(
        "positive_margin", F.greatest(F.lit(POSITIVE_FLOOR), F.col("positive_threshold"))
    ).withColumn(
        "negative_margin", F.least(F.lit(NEGATIVE_CEILING), F.col("negative_threshold"))
    )
