"""Applying a fitted model to a pool: score, route, and keep the best copies per route."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import dedup, routing
from gleaner.operators.ensemble import EnsembleModel
from gleaner.operators.metrics import tail_fractions
from gleaner.plans.train import score_items

# Fixed value: similarity threshold inside the routed sets.
ROUTED_DUPLICATES_THRESHOLD = 0.95


def score_and_route(
    model: EnsembleModel,
    pool: DataFrame,
    positive: float = routing.POSITIVE_THRESHOLD,
    negative: float = routing.NEGATIVE_THRESHOLD,
) -> tuple[DataFrame, DataFrame]:
    """``(routed, tails)``: scored items per route and the shares of clear cases."""
    scores = score_items(model, pool)
    return routing.route_items(scores, positive, negative), tail_fractions(scores)


def dedup_routed(
    routed: DataFrame,
    features: DataFrame,
    n_models: int,
    threshold: float = ROUTED_DUPLICATES_THRESHOLD,
) -> DataFrame:
    """Drop near duplicates inside each route, keeping the best-scored copy.

    ``n_models`` is the number of models side by side in the vectors.
    Items without features have nothing to be compared by and stay.
    """
    with_vectors = routed.select("sample_id", "route", "p").join(
        features.select("sample_id", "vec"), "sample_id", "left"
    )
    kept = dedup.survivors(
        with_vectors, order=["p"], threshold=threshold, n_models=n_models, group=["route"]
    )
    return routed.join(kept, ["sample_id", "route"], "left_semi")


def dedup_across_routes(
    routed: DataFrame,
    features: DataFrame,
    n_models: int,
    threshold: float = ROUTED_DUPLICATES_THRESHOLD,
) -> DataFrame:
    """Drop items that have a near duplicate in another route with a clearer score.

    Clearer is farther from one half; the id breaks ties. Items of one route are left to
    ``dedup_routed``. Items without features or without a score stay.
    """
    with_vectors = routed.join(features.select("sample_id", "vec"), "sample_id", "left")
    compared = with_vectors.where("p IS NOT NULL").select(
        "sample_id", "route", F.abs(F.col("p") - 0.5).alias("clearness"), "vec"
    )
    kept = dedup.survivors_across(
        compared, "route", order=["clearness"], threshold=threshold, n_models=n_models
    )
    unscored = routed.where("p IS NULL")
    return routed.join(kept, ["sample_id", "route"], "left_semi").unionByName(unscored)
