"""Evaluation of score tables. Every function aggregates per value of ``by``.

``p`` names a score column in [0, 1], ``y`` a label column holding 0 and 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import ranks, vectors
from gleaner.session import staged

SWEEP_POINTS = 101
RATIO_BASELINE = 0.001


def _hit(p: str, y: str) -> Column:
    return ((F.col(p) > 0.5).cast("double") == F.col(y).cast("double")).cast("double")


def accuracy(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows with ``(p > 0.5) == y``; a score of exactly 0.5 counts as class 0."""
    return df.groupBy(*by).agg(F.avg(_hit(p, y)).alias("accuracy"))


def rmse(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Root mean squared error; array columns average over all their cells."""
    if df.schema[p].dataType.typeName() == "array":
        cells = F.zip_with(p, y, lambda a, b: (a - b) * (a - b))
        total = F.sum(vectors.array_sum(cells)) / F.sum(F.size(p))
        return df.groupBy(*by).agg(F.sqrt(total).alias("rmse"))
    return df.groupBy(*by).agg(F.sqrt(F.avg(F.pow(F.col(p) - F.col(y), 2))).alias("rmse"))


def auc(
    df: DataFrame, p: str, y: str, by: Sequence[str] = (), n_buckets: int = 256
) -> DataFrame:
    """Exact area under the ROC curve, ties counting half; null with a single class.

    Mann-Whitney over counts per distinct score. The counts are written once, so ``df`` is
    computed once. Scores are cut into quantile buckets: the running count of negatives
    is taken inside a bucket and carried across buckets by their totals, and no task sees
    the whole order.
    """
    by = list(by)
    per_score = (
        df.where(F.col(p).isNotNull())
        .groupBy(*by, F.col(p).cast("double").alias("score"))
        .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    )
    per_score = ranks.order_buckets(staged(per_score, "score_counts"), "score", n_buckets)

    def below(*partition: str, order: str) -> Column:
        earlier = (
            Window.partitionBy(*partition)
            .orderBy(order)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        return F.coalesce(F.sum("neg").over(earlier), F.lit(0))

    inside = per_score.withColumn("below", below(*by, "bucket", order="score"))
    per_bucket = inside.groupBy(*by, "bucket").agg(
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("wins"),
    )
    total = per_bucket.withColumn("below", below(*by, order="bucket"))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    wins = F.sum(F.col("wins") + F.col("pos") * F.col("below"))
    return total.groupBy(*by).agg(F.when(pairs > 0, wins / pairs).alias("auc"))


def evaluate(df: DataFrame, p: str, y: str, by: Sequence[str]) -> DataFrame:
    """Accuracy, RMSE, AUC and row count per value of ``by``."""
    direct = df.groupBy(*by).agg(
        F.avg(_hit(p, y)).alias("accuracy"),
        F.sqrt(F.avg(F.pow(F.col(p) - F.col(y), 2))).alias("rmse"),
        F.count("*").alias("n"),
    )
    return direct.join(auc(df, p, y, by), list(by))


def threshold_sweep(
    df: DataFrame, p: str, y: str, by: Sequence[str] = (), n: int = SWEEP_POINTS
) -> DataFrame:
    """Rates per threshold ``t`` on ``n`` grid points over [0, 1].

    tp = P(p > t | y = 1), fp = P(p > t | y = 0), fn = P(p <= t | y = 1),
    tn = P(p <= t | y = 0). Rows are counted once per grid cell; the cumulative sums run
    over at most ``n + 1`` counts per group.
    """
    by = list(by)
    index = vectors.first_grid_index_at_or_above(F.col(p).cast("double"), n)
    cells = (
        df.where(F.col(p).isNotNull())
        .groupBy(*by, index.alias("k"))
        .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    )
    entry = F.struct("k", F.struct("pos", "neg"))
    grid = (
        cells.groupBy(*by)
        .agg(
            F.sum("pos").alias("all_pos"),
            F.sum("neg").alias("all_neg"),
            F.map_from_entries(F.collect_list(entry)).alias("cells"),
        )
        .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("cell", F.try_element_at("cells", F.col("k")))
    )
    up_to = (
        Window.partitionBy(*by, "all_pos", "all_neg")
        .orderBy("k")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def at_or_below(name: str) -> Column:
        return F.sum(F.coalesce(F.col(f"cell.{name}"), F.lit(0))).over(up_to)

    def rate(count: Column, total: str) -> Column:
        return F.when(F.col(total) > 0, count.cast("double") / F.col(total))

    counted = grid.select(
        *by,
        "k",
        "all_pos",
        "all_neg",
        at_or_below("pos").alias("low_pos"),
        at_or_below("neg").alias("low_neg"),
    )
    return counted.select(
        *by,
        "k",
        vectors.grid_value(F.col("k"), n).alias("t"),
        rate(F.col("all_pos") - F.col("low_pos"), "all_pos").alias("tp"),
        rate(F.col("all_neg") - F.col("low_neg"), "all_neg").alias("fp"),
        rate(F.col("low_pos"), "all_pos").alias("fn"),
        rate(F.col("low_neg"), "all_neg").alias("tn"),
    )


def ratio_curves(sweep: DataFrame, baseline: float = RATIO_BASELINE) -> DataFrame:
    """Add tp / (fp + baseline) and tn / (fn + baseline) to a sweep."""
    return sweep.withColumn("positives_ratio", F.col("tp") / (F.col("fp") + baseline)).withColumn(
        "negatives_ratio", F.col("tn") / (F.col("fn") + baseline)
    )


def histogram(df: DataFrame, p: str, edges: int = 100, by: Sequence[str] = ()) -> DataFrame:
    """Counts in the ``edges - 1`` equal bins over [0, 1], empty bins included.

    Bins are closed on the left, the last one on both sides; other scores are ignored.
    """
    by = list(by)
    counts = df.groupBy(*by, vectors.bin_index(F.col(p).cast("double"), edges).alias("bin")).agg(
        F.count("*").alias("n")
    )
    filled = F.filter(F.collect_list(F.struct("bin", "n")), lambda e: e.bin.isNotNull())
    return (
        counts.groupBy(*by)
        .agg(F.map_from_entries(filled).alias("bins"))
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(edges - 2))))
        .select(
            *by,
            "bin",
            vectors.grid_value(F.col("bin"), edges).alias("left_edge"),
            F.coalesce(F.try_element_at("bins", F.col("bin")), F.lit(0)).alias("n"),
        )
    )


# Fixed values: (rows below this number, edges) per kind of histogram.
_ADAPTIVE_EDGES = {
    "validation": ((200, 10), (1000, 25), (None, 100)),
    "prediction": ((150, 12), (1000, 25), (None, 100)),
    "session": ((None, 12),),
}


def adaptive_edges(kind: str, n_rows: int) -> int:
    """Number of bin edges for a kind of histogram over ``n_rows`` rows."""
    for below, edges in _ADAPTIVE_EDGES[kind]:
        if below is None or n_rows < below:
            return edges
    raise AssertionError(kind)


def adaptive_histogram(
    df: DataFrame, p: str, kind: str, by: Sequence[str] = (), labeled: str | None = None
) -> DataFrame:
    """Histogram whose bin width follows the number of rows.

    The number of rows is that of ``df``; with ``labeled`` (a boolean column) the counts
    leave out the rows already labeled.
    """
    edges = adaptive_edges(kind, df.count())
    counted = df.where(~F.col(labeled)) if labeled else df
    return histogram(counted, p, edges, by)


def tail_fractions(df: DataFrame, p: str = "p", hi: float = 0.85, lo: float = 0.25) -> DataFrame:
    """Shares of rows with ``p >= hi`` and ``p <= lo``, and both as rounded percentages."""
    above = F.avg((F.col(p) >= hi).cast("double"))
    below = F.avg((F.col(p) <= lo).cast("double"))
    return df.agg(
        above.alias("share_high"),
        below.alias("share_low"),
        F.round(100 * above, 1).alias("percent_high"),
        F.round(100 * below, 1).alias("percent_low"),
    )


def multiclass_accuracy(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Share of rows whose largest predicted and true class agree (array columns)."""
    hit = (vectors.argmax(predicted) == vectors.argmax(truth)).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"))


def score_pairs(scores: DataFrame, first: str = "p_knn", second: str = "p_lr") -> DataFrame:
    """Two scores side by side per labeled item."""
    return scores.select("sample_id", "label", first, second)
