import numpy as np
import pandas as pd
import pytest

from gleaner.functions import vectors
from gleaner.operators import ensemble_weights, folds, labeling, metrics, peaks, validate
from pyspark.sql import functions as F


def scores(spark, p, y):
    return spark.createDataFrame(
        [(float(a), float(b)) for a, b in zip(p, y)], "p double, label double"
    )


def brute_auc(p, y):
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("digits,buckets", [(1, 4), (2, 256), (9, 16)])
def test_auc_with_ties(spark, digits, buckets):
    rng = np.random.default_rng(digits)
    p = np.round(rng.random(500), digits)
    p[:170] = p[0]
    y = (rng.random(500) < 0.3 + 0.4 * p).astype(float)
    got = metrics.auc(scores(spark, p, y), "p", "label", n_buckets=buckets).first().auc
    assert got == pytest.approx(brute_auc(p, y), abs=1e-12)


def test_auc_of_one_class_is_null(spark):
    assert metrics.auc(scores(spark, [0.1, 0.9], [1, 1]), "p", "label").first().auc is None


def test_half_counts_as_class_zero(spark):
    df = scores(spark, [0.5, 0.5, 0.51], [0, 1, 1])
    assert metrics.accuracy(df, "p", "label").first().accuracy == pytest.approx(2 / 3)


def test_sweep_on_grid_values(spark):
    """Scores on, just below and just above every threshold."""
    grid = np.linspace(0, 1, 101)
    p = np.clip(np.concatenate([grid, np.nextafter(grid, 0), np.nextafter(grid, 1),
                                np.arange(101) / 100]), 0, 1)
    y = (np.arange(len(p)) % 2).astype(float)
    rows = metrics.threshold_sweep(scores(spark, p, y), "p", "label").orderBy("k").toPandas()
    assert len(rows) == 101
    np.testing.assert_array_equal(rows.t, grid)
    np.testing.assert_allclose(rows.tp, [(p[y == 1] > t).mean() for t in grid])
    np.testing.assert_allclose(rows.fp, [(p[y == 0] > t).mean() for t in grid])
    np.testing.assert_allclose(rows.tp + rows.fn, 1)
    np.testing.assert_allclose(rows.fp + rows.tn, 1)


@pytest.mark.parametrize("edges", [10, 12, 25, 100])
def test_histogram_equals_numpy(spark, edges):
    grid = np.linspace(0, 1, edges)
    p = np.concatenate([grid, np.nextafter(grid, 0), np.nextafter(grid, 1), [0.0, 1.0, 0.5]])
    inside = p[(p >= 0) & (p <= 1)]
    got = metrics.histogram(scores(spark, p, p * 0), "p", edges).orderBy("bin").toPandas()
    expected = np.histogram(inside, bins=grid)[0]
    np.testing.assert_array_equal(got.n, expected)


def test_adaptive_edges():
    assert [metrics.adaptive_edges("validation", n) for n in (199, 200, 999, 1000)] == [10, 25, 25, 100]
    assert [metrics.adaptive_edges("prediction", n) for n in (149, 150, 1000)] == [12, 25, 100]
    assert metrics.adaptive_edges("session", 10**6) == 12


def curve(spark, ratios):
    return spark.createDataFrame(
        [(k, k / 100, float(r), float(r)) for k, r in enumerate(ratios)],
        "k int, t double, positives_ratio double, negatives_ratio double",
    )


@pytest.mark.parametrize(
    "ratios,expected",
    [
        ([1, 2, 3, 4], []),
        ([1, 30, 1, 30, 30, 30, 2], [1, 4]),
        ([30, 1, 1, 30], []),
        ([1, 29, 29, 28, 30], [1]),
        ([5, 5, 5], []),
    ],
)
def test_peaks(spark, ratios, expected):
    found = peaks.curve_peaks(curve(spark, ratios), "positives_ratio")
    assert sorted(r.k for r in found.collect()) == expected


def test_margins_without_peak(spark):
    margins = peaks.safe_margins(peaks.ratio_peaks(curve(spark, [1, 2, 3]))).first()
    assert margins.positive_threshold is None and margins.negative_threshold is None
    assert (margins.positive_margin, margins.negative_margin) == (0.65, 0.35)


def test_tail_fractions(spark):
    row = metrics.tail_fractions(scores(spark, [0.25, 0.85, 0.5, 0.9], [0] * 4)).first()
    assert (row.share_high, row.share_low, row.percent_high) == (0.5, 0.25, 50.0)


def test_vector_functions(spark):
    df = spark.createDataFrame(
        [(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None)], "sample_id int, v array<double>"
    )
    rows = df.select(
        vectors.l2_normalize("v").alias("u"), vectors.l2_norm("v").alias("n"),
        vectors.argmax("v").alias("a"), vectors.dot("v", "v").alias("d"),
        vectors.euclidean("v", "v").alias("e"), vectors.one_hot("sample_id", 3).alias("h"),
        vectors.linspace(5).alias("l"),
    ).collect()
    assert rows[0].u == [0.6, 0.8] and rows[0].n == 5.0 and rows[0].a == 1 and rows[0].d == 25.0
    assert rows[0].e == 0.0 and rows[0].l == [0.0, 0.25, 0.5, 0.75, 1.0]
    assert rows[1].u is None and rows[2].u is None and rows[2].h == [0.0, 0.0, 1.0]


def oof(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.5).astype(float)
    cols = [np.clip(0.5 + 0.3 * (2 * y - 1) + rng.normal(0, 0.25, n), 0, 1) for _ in range(3)]
    return spark.createDataFrame(
        pd.DataFrame({"sample_id": range(n), "label": y, "p_knn": cols[0], "p_lr": cols[1],
                      "p_gbt": cols[2]})
    )


def test_weight_search_equals_the_metrics_of_each_triple(spark):
    table = oof(spark)
    blank = spark.createDataFrame([(9000 + i, float(i % 2), None, 0.5, 0.5) for i in range(3)], table.schema)
    weights = ensemble_weights.random_weights(spark, 6, seed=3)
    found = ensemble_weights.weight_search(table.unionByName(blank), weights)
    for w in found.collect():
        p = w.w_knn * F.col("p_knn") + w.w_lr * F.col("p_lr") + w.w_gbt * F.col("p_gbt")
        mixed = table.withColumn("p", p).withColumn("g", F.lit(0))
        assert w.auc == pytest.approx(metrics.auc(mixed, "p", "label", ["g"]).first().auc)
        assert w.accuracy == pytest.approx(metrics.accuracy(mixed, "p", "label", ["g"]).first().accuracy)
        curves = metrics.ratio_curves(metrics.threshold_sweep(mixed, "p", "label", ["g"]))
        margins = peaks.safe_margins(peaks.ratio_peaks(curves, by=["g"])).first()
        assert (w.positive_margin, w.negative_margin) == pytest.approx(
            (margins.positive_margin, margins.negative_margin))
    best = ensemble_weights.best_weights(found).first()
    assert best.score == pytest.approx(max(r.score for r in found.collect()))
    assert best.w_knn + best.w_lr + best.w_gbt == pytest.approx(1)


def test_weight_search_with_one_class_or_a_bound(spark):
    table = oof(spark)
    weights = ensemble_weights.random_weights(spark, 5, seed=3)
    one = ensemble_weights.weight_search(table.where("label = 1"), weights)
    assert all(r.auc is None and r.score is None and r.accuracy is not None for r in one.collect())
    assert ensemble_weights.best_weights(one).first().weight_id == 0
    none = ensemble_weights.weight_search(table.where("label = 5"), weights)
    assert all(r.auc is None and r.accuracy is None for r in none.collect())
    some = ensemble_weights.weight_search(table, weights, max_rows=50).collect()
    assert some == ensemble_weights.weight_search(table.repartition(7), weights, max_rows=50).collect()


def test_weight_search_judges_all_rows_whatever_the_blocks(spark):
    table = oof(spark, 400, seed=5)
    table = table.unionByName(table.limit(90))
    weights = ensemble_weights.random_weights(spark, 6, seed=3)
    whole = ensemble_weights.weight_search(table, weights).orderBy("weight_id").collect()
    cut = ensemble_weights.weight_search(table, weights, max_rows=40).orderBy("weight_id").collect()
    assert cut == whole
    w = whole[2]
    p = w.w_knn * F.col("p_knn") + w.w_lr * F.col("p_lr") + w.w_gbt * F.col("p_gbt")
    mixed = table.withColumn("p", p).withColumn("g", F.lit(0))
    assert cut[2].auc == pytest.approx(metrics.auc(mixed, "p", "label", ["g"]).first().auc)
    assert cut[2].accuracy == pytest.approx(metrics.accuracy(mixed, "p", "label", ["g"]).first().accuracy)


def test_weights_are_at_least_three_percent_before_normalising(spark):
    rows = ensemble_weights.random_weights(spark, 500).toPandas()
    assert (rows[["w_knn", "w_lr", "w_gbt"]].min(axis=1) >= 0.03 / 2.03).all()
    assert ensemble_weights.grid_weights(spark).count() == 36


def test_folds_keep_class_shares(spark):
    table = spark.createDataFrame(
        [(i, float(i % 7 == 0)) for i in range(203)], "sample_id long, label double"
    )
    drawn = folds.stratified_folds(table, "sample_id", "label", n_repeats=2).toPandas()
    assert len(drawn) == 406
    sizes = drawn.groupby(["repeat", "label", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()
    assert not (drawn[drawn.repeat == 0].sort_values("sample_id").fold.values
                == drawn[drawn.repeat == 1].sort_values("sample_id").fold.values).all()


def test_shuffle_split_is_exact(spark):
    table = spark.range(101).withColumnRenamed("id", "sample_id")
    sizes = folds.shuffle_split(table, "sample_id", 0.7).groupBy("subset").count().collect()
    assert {r.subset: r["count"] for r in sizes} == {"train": 70, "valid": 31}


def test_fold_metrics(spark):
    table = folds.stratified_folds(oof(spark), "sample_id", "label")
    table = table.withColumn("subset", F.lit("valid")).withColumn("p_ensemble", F.col("p_lr"))
    got = validate.fold_metrics(table).toPandas()
    assert len(got) == 5 * 4
    one = table.where("fold = 2").toPandas()
    expected = brute_auc(one.p_knn.values, one.label.values)
    assert got[(got.fold == 2) & (got.classifier == "kNN")].auc.iloc[0] == pytest.approx(expected)


def test_session_of_one_class_is_all_zero(spark):
    judged = spark.createDataFrame([(1, 0.9, 1)], "sample_id int, p double, label int")
    row = labeling.summarize_session(judged).first()
    assert (row.accuracy, row.auc, row.n) == (0.0, 0.0, 0)
    row = labeling.summarize_session(judged.limit(0)).first()
    assert (row.accuracy, row.auc, row.n) == (0.0, 0.0, 0)
