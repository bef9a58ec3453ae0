"""Routing scored items to the likely positive and likely negative sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import keys

# Default thresholds, both inclusive.
POSITIVE_THRESHOLD = 0.7
NEGATIVE_THRESHOLD = 0.3
# Fixed value: the score of every item while there is no usable classifier.
COLD_START_SCORE = 0.1


def route_items(
    scores: DataFrame,
    positive: float = POSITIVE_THRESHOLD,
    negative: float = NEGATIVE_THRESHOLD,
    p: str = "p",
    keep_unrouted: bool = False,
) -> DataFrame:
    """One row per (item, route); ``keep_unrouted`` adds the other items with a null route.

    ``p <= negative`` goes to ``negative`` and ``p >= positive`` to ``positive``; the two
    tests are independent, so overlapping thresholds send an item to both.
    """
    routes = F.array_compact(
        F.array(
            F.when(F.col(p) <= negative, F.lit("negative")),
            F.when(F.col(p) >= positive, F.lit("positive")),
        )
    )
    unpack = F.explode_outer if keep_unrouted else F.explode
    return scores.withColumn("route", unpack(routes))


def residual(items: DataFrame, routed: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Items that were not routed anywhere."""
    return items.join(routed.select(id_col), id_col, "left_anti")


def routed_features(
    routed: DataFrame, features: DataFrame, id_col: str = "sample_id", seed: int | str = 0
) -> DataFrame:
    """Features of the routed items under their suffixed destination id."""
    return (
        routed.select(id_col, "route")
        .join(features, id_col)
        .withColumn("dest_id", keys.routed_id(id_col, seed))
    )


def write_routed(
    routed: DataFrame,
    items: DataFrame,
    features: DataFrame,
    out: str,
    run_id: str,
    source: str = "",
    id_col: str = "sample_id",
    path: str | None = None,
) -> None:
    """Add routed items and their features to the sets below ``out``.

    Every run writes a folder of its own, one per route inside: earlier runs stay, and a
    repeated run replaces its own rows. Destination ids get a suffix that differs by
    ``source``, so equal names from two folders do not meet; with a ``path`` column they
    come with ``dest_name``, the id with the item's extension. The sources are not touched;
    ``residual`` gives what deleting the routed items from the source would leave.
    """
    out = out.rstrip("/")
    seed = f"{source}/" if source else 0
    renamed = (
        routed.select(id_col, "route")
        .join(items, id_col)
        .withColumn("dest_id", keys.routed_id(id_col, seed))
    )
    if path:
        name = F.concat_ws(".", "dest_id", keys.extension(path))
        renamed = renamed.withColumn("dest_name", name)
    moved = routed_features(routed, features, id_col, seed)
    for rows, name in ((renamed, "images"), (moved, "pretrained_features")):
        folder = f"{out}/{name}/run={run_id}"
        rows.write.mode("overwrite").partitionBy("route").parquet(folder)


def read_routed(spark: SparkSession, out: str, name: str = "images") -> DataFrame:
    """The routed sets of all runs, with the columns ``run`` and ``route``."""
    return spark.read.parquet(f"{out.rstrip('/')}/{name}").withColumn(
        "run", F.col("run").cast("string")
    )


def cold_start_scores(items: DataFrame) -> DataFrame:
    """Scores to start labeling with: the same low value for every item."""
    return items.withColumn("p", F.lit(COLD_START_SCORE))
