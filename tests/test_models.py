import datetime

import numpy as np
import pandas as pd
import pytest

from gleaner.functions import vectors
from gleaner.operators import knn, linear, trees
from gleaner.operators.ensemble import weighted_score
from gleaner.operators.params import (
    DEFAULT, EnsembleParams, KnnParams, LogisticParams, TRAINING, for_sample_size,
)
from dataclasses import replace

from gleaner.plans import train
from gleaner.plans.apply import dedup_routed, score_and_route
from gleaner.session import new_path
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from gleaner.sources.models import load_model, model_name, save_model

QUICK = replace(DEFAULT, boosting=(5, 0.3))


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n, width = 180, 8
    y = (rng.random(n) < 0.5).astype(float)
    x = rng.normal(size=(n, width)) + 1.2 * y[:, None] * (np.arange(width) < 3)
    df = spark.createDataFrame(
        pd.DataFrame({"sample_id": [f"s{i:03d}" for i in range(n)], "vec": list(x), "label": y}),
        "sample_id string, vec array<double>, label double",
    ).persist()
    df.count()
    return df, x, y


def in_order(df, column):
    return np.array([r[column] for r in df.orderBy("sample_id").collect()])


def test_logistic_equals_newton(data):
    df, x, y = data
    params = LogisticParams(c=0.75, class_weight=(0.5, 0.8))
    model = linear.fit_logistic(df, params)
    xb = np.c_[x, np.ones(len(x))]
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    sample_weight = np.where(y == 1, 0.8, 0.5)
    w = np.zeros(xb.shape[1])
    for _ in range(40):
        p = sigmoid(xb @ w)
        gradient = penalty @ w + params.c * xb.T @ (sample_weight * (p - y))
        hessian = penalty + params.c * (xb * (sample_weight * p * (1 - p))[:, None]).T @ xb
        w -= np.linalg.solve(hessian, gradient)
    np.testing.assert_allclose(in_order(model.predict(df), "p_lr"), sigmoid(xb @ w), atol=1e-6)


def test_discriminant_equals_closed_form(data):
    df, x, y = data
    model = linear.fit_discriminant(df)
    m0, m1 = x[y == 0].mean(0), x[y == 1].mean(0)
    centred = np.where(y[:, None] == 1, x - m1, x - m0)
    w = np.linalg.solve(centred.T @ centred / (len(x) - 2), m1 - m0)
    expected = sigmoid(x @ w - w @ (m0 + m1) / 2)
    np.testing.assert_allclose(in_order(model.predict(df), "p_lda"), expected, atol=1e-8)


def test_discriminant_with_dependent_columns(spark, data):
    _, x, y = data
    wide = np.c_[x, x[:, :2].sum(1)]
    df = spark.createDataFrame(
        pd.DataFrame({"sample_id": [f"s{i:03d}" for i in range(len(x))], "vec": list(wide),
                      "label": y}),
        "sample_id string, vec array<double>, label double",
    )
    plain = linear.fit_discriminant(data[0])
    wider = linear.fit_discriminant(df)
    np.testing.assert_allclose(
        in_order(wider.predict(df), "p_lda"), in_order(plain.predict(data[0]), "p_lda"), atol=1e-6
    )


@pytest.mark.parametrize("whiten", [False, True])
def test_compressed_knn_equals_numpy(data, whiten):
    df, x, y = data
    model = knn.fit_knn(df, KnnParams(n_cols=5, n_rows=30, n_neighbors=4, whiten=whiten))
    centred = x - x.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    np.testing.assert_allclose(model.explained, (s**2 / (s**2).sum())[:5], rtol=1e-9)
    assert model.templates.shape == (30, 5)
    # Reduced coordinates up to the sign of each axis.
    z = np.abs(centred @ vt[:5].T)
    if whiten:
        z = z / (s[:5] / np.sqrt(len(x) - 1))
    reduced = model.reducer.transform(
        df.withColumn("knn_in", knn.array_to_vector("vec"))
    )
    got = np.array([r.knn_z.toArray() for r in reduced.orderBy("sample_id").collect()])
    np.testing.assert_allclose(np.abs(got), z, atol=1e-8)
    # Prediction: brute force over the templates.
    d2 = ((got[:, None, :] - model.templates[None]) ** 2).sum(-1)
    near = np.argsort(d2, axis=1, kind="stable")[:, : model.n_neighbors]
    np.testing.assert_allclose(
        in_order(model.predict(df), "p_knn"), model.labels[near, 0].mean(1), atol=1e-12
    )
    report = model.report(df).first()
    assert report.numbers_percent == pytest.approx(100 * 30 * 5 / x.size)
    assert 0 < report.variance_percent <= 100
    assert model.pca_variance(df).orderBy("component").collect()[-1].cumulative == pytest.approx(
        sum(model.explained)
    )


def test_empty_clusters_are_zero(spark):
    df = spark.createDataFrame(
        [(0, [1.0, 2.0], [1.0]), (0, [3.0, 4.0], [0.0]), (2, [5.0, 5.0], [1.0])],
        "cluster int, vec array<double>, y array<double>",
    )
    rows = knn.template_aggregate(df, "cluster", "vec", "y", 4).orderBy("template_id").collect()
    assert [(r.vec, r.y) for r in rows] == [
        ([2.0, 3.0], [0.5]), ([0.0, 0.0], [0.0]), ([5.0, 5.0], [1.0]), ([0.0, 0.0], [0.0])
    ]


def test_knn_join_in_blocks(spark):
    rng = np.random.default_rng(1)
    q, t = rng.normal(size=(50, 4)), rng.normal(size=(30, 4))
    t[10] = t[3]
    y = np.eye(3)[rng.integers(0, 3, 30)]
    queries = spark.createDataFrame(
        pd.DataFrame({"sample_id": range(50), "vec": list(q)}), "sample_id long, vec array<double>"
    )
    templates = spark.createDataFrame(
        pd.DataFrame({"template_id": range(30), "vec": list(t), "y": list(y)}),
        "template_id long, vec array<double>, y array<double>",
    )
    near = np.argsort(((q[:, None] - t[None]) ** 2).sum(-1), axis=1, kind="stable")[:, :5]
    for block_bytes in (64 << 20, 200):
        got = knn.knn_join(queries, templates, 5, block_bytes=block_bytes)
        rows = np.array([r.y_hat for r in got.orderBy("sample_id").collect()])
        np.testing.assert_allclose(rows, y[near].mean(1), atol=1e-12)


def test_nearest_breaks_ties_by_position():
    at, _ = knn.nearest(np.zeros((1, 2)), np.array([[1.0, 0], [0, 1], [-1, 0], [0, 0]]), 2)
    assert at.tolist() == [[3, 0]] or sorted(at[0]) == [0, 3]


def test_trees_separate(data):
    df, _, y = data
    params = replace(
        DEFAULT, boosting=(20, 0.3), trees=replace(DEFAULT.trees, min_data_in_leaf=10)
    )
    p = in_order(trees.fit_trees(df, params).predict(df), "p_gbt")
    assert ((p > 0.5) == y).mean() > 0.8 and (p >= 0).all() and (p <= 1).all()


def test_small_sample_rule():
    small = for_sample_size(DEFAULT, 799)
    assert (small.knn.n_cols, small.knn.n_rows, small.knn.n_neighbors) == (80, 479, 9)
    assert (small.logistic.c, small.trees.num_trees) == (0.1, 750)
    assert (small.trees.min_data_in_leaf, small.trees.row_sample) == (100, 0.6)
    tiny = for_sample_size(DEFAULT, 87)
    assert (tiny.knn.n_cols, tiny.knn.n_rows, tiny.trees.min_data_in_leaf) == (60, 52, 21)
    assert for_sample_size(DEFAULT, 800) is DEFAULT
    assert DEFAULT.knn.n_cols == 120 and TRAINING.logistic.c == 0.75
    assert EnsembleParams.from_json(small.to_json()) == small


def test_model_names():
    day = datetime.date(2022, 9, 5)
    assert model_name("a", 200, 6784, day) == "a_num_samples_200_num_features_6784_2022-09-05"
    assert model_name("a", None, 6784, day) == "a_2022-09-05"


def test_ensemble_lies_between_members_and_survives_saving(spark, data):
    df, x, _ = data
    training = train.fit_from_sets(
        df.where("label = 1").drop("label"), df.where("label = 0").drop("label"), QUICK, ["m"]
    )
    model = training.model
    assert training.oof is None and model.best is None
    assert model.n_positive + model.n_negative == len(x)
    scores = train.score_items(model, df).orderBy("sample_id").toPandas()
    members = scores[["p_knn", "p_lr", "p_gbt"]]
    assert (scores.p >= members.min(axis=1) - 1e-12).all()
    assert (scores.p <= members.max(axis=1) + 1e-12).all()
    path = save_model(spark, model, new_path(spark, "models"))
    loaded = load_model(spark, path)
    again = train.score_items(loaded, df).orderBy("sample_id").toPandas()
    pd.testing.assert_frame_equal(scores, again)
    assert loaded.models_for_features == ("m",) and loaded.n_positive == model.n_positive
    only_lr = train.score_items(model, df, weights=[0, 2, 0]).orderBy("sample_id").toPandas()
    np.testing.assert_allclose(only_lr.p, only_lr.p_lr)
    # A null vector keeps a null score, a vector of another width fails.
    extra = spark.createDataFrame([("n", None)], "sample_id string, vec array<double>")
    assert train.score_items(model, extra).first().p is None
    wrong = spark.createDataFrame([("w", [1.0])], "sample_id string, vec array<double>")
    with pytest.raises(Exception, match="expected vectors of width 8"):
        train.score_items(model, wrong).collect()
    routed, tails = score_and_route(model, df, 0.6, 0.4)
    assert set(r.route for r in routed.collect()) == {"positive", "negative"}
    assert 0 <= tails.first().share_high <= 1
    assert dedup_routed(
        routed, df.withColumn("vec", vectors.l2_normalize("vec")), 1, 0.9
    ).count() <= routed.count()
    with pytest.raises(ValueError):
        train.keep_best_copies(model, df, ["other"])
    # Among two copies the later id wins: both have the same score.
    twins = df.limit(20).withColumn("sample_id", F.concat(F.lit("t"), "sample_id"))
    unit = df.unionByName(twins).withColumn("vec", vectors.l2_normalize("vec"))
    kept = train.keep_best_copies(model, unit, ["m"], 0.999999)
    assert sorted(r.sample_id for r in kept.collect() if r.sample_id.startswith("t")) == sorted(
        r.sample_id for r in twins.collect()
    )
    assert kept.count() == df.count()


def test_cross_validation_gate_and_result(spark, data):
    df, x, y = data
    assert train.fit_labeled(df.limit(80), QUICK, perform_cross_validation=True).oof is None
    training = train.fit_labeled(
        df, QUICK, perform_cross_validation=True, reset_weights=True, n_weights=50
    )
    oof = training.oof.toPandas()
    assert sorted(oof.sample_id) == sorted(r.sample_id for r in df.collect())
    assert len(training.fold_metrics.collect()) == 5 * 2 * 4
    best = training.model.best
    assert training.model.params.weights == (best["w_knn"], best["w_lr"], best["w_gbt"])
    assert best["positive_margin"] >= 0.65 and best["negative_margin"] <= 0.35
    assert best["auc"] > 0.7


def test_weighted_score_checks_lengths():
    with pytest.raises(ValueError):
        weighted_score([0.5, 0.5])


def test_fits_leave_out_rows_without_a_vector(spark, data):
    df, _, _ = data
    blank = spark.createDataFrame([("z1", None, 1.0), ("z2", None, 0.0)], df.schema)
    both = df.unionByName(blank)
    small = replace(DEFAULT.knn, n_cols=5, n_rows=20, n_neighbors=3)
    fits = {
        "p_lr": lambda rows: linear.fit_logistic(rows, DEFAULT.logistic),
        "p_lda": linear.fit_discriminant,
        "p_gbt": lambda rows: trees.fit_trees(rows, QUICK),
        "p_knn": lambda rows: knn.fit_knn(rows, small),
    }
    for column, fit in fits.items():
        scores = {r.sample_id: r[column] for r in fit(both).predict(both).collect()}
        assert scores.pop("z1") is None and scores.pop("z2") is None
        plain = {r.sample_id: r[column] for r in fit(df).predict(df).collect()}
        assert scores == pytest.approx(plain, abs=1e-6)
    training = train.fit_labeled(both, QUICK, perform_cross_validation=True, n_weights=10)
    assert training.n_without_vector == 2
    assert training.model.n_positive + training.model.n_negative == df.count()
    assert training.oof.where("p_ensemble is null").count() == 2


def test_knn_join_gives_null_without_a_vector(spark):
    templates = spark.createDataFrame(
        [(i, [float(i), 0.0], [float(i)]) for i in range(8)], "template_id long, vec array<double>, y array<double>")
    queries = spark.createDataFrame(
        [("a", [2.1, 0.0]), ("b", None)], "sample_id string, vec array<double>")
    for block_bytes in (1 << 20, 64):
        got = knn.knn_join(queries, templates, 2, block_bytes=block_bytes).collect()
        assert {r.sample_id: r.y_hat for r in got} == {"a": [2.5], "b": None}


def test_retrain_saves_a_model_that_keeps_best_copies(spark, data):
    """Two models side by side: duplicates are counted by both, the loaded model knows them."""
    df, _, _ = data
    half = lambda a: vectors.l2_normalize(F.slice("vec", a, 4))
    unit = df.withColumn("vec", F.concat(half(1), half(5)))
    twins = unit.limit(15).withColumn("sample_id", F.concat(F.lit("t"), "sample_id"))
    labeled = unit.unionByName(twins)
    training, scores = train.retrain_and_rescore(
        labeled, unit, QUICK, new_path(spark, "models"), n_weights=10,
        models_for_features=["a", "b"], remove_duplicates=True, similarity_threshold=0.9999,
    )
    assert training.model.n_positive + training.model.n_negative == unit.count()
    loaded = load_model(spark, training.path)
    again = train.score_items(loaded, unit)
    assert scores.exceptAll(again).isEmpty() and again.count() == unit.count()
    kept = train.keep_best_copies(loaded, labeled, ["a", "b"], 0.9999)
    assert kept.count() == unit.count()


def test_kmeans_equals_that_of_spark(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 5)) + 4 * rng.integers(0, 3, size=(600, 1))
    rows = spark.createDataFrame(pd.DataFrame({"vec": list(x)}), "vec array<double>").repartition(3)
    rows = rows.select("vec", array_to_vector("vec").alias("z")).persist()
    rows.count()
    for most in (100, 2):
        theirs = KMeans(k=20, seed=3, featuresCol="z", maxIter=most).fit(rows)
        ours = knn.cluster(rows, "z", 20, 3, most)
        np.testing.assert_allclose(ours.centres, theirs.clusterCenters(), atol=1e-9)
        assert ours.steps == theirs.summary.numIter
        assert ours.cost == pytest.approx(theirs.summary.trainingCost)
        told = {tuple(r.vec): r.prediction for r in ours.assign(rows, "vec").collect()}
        assert told == {tuple(r.vec): r.prediction for r in theirs.transform(rows).collect()}


def test_rows_at_rest_are_not_compared_with_all_centres(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 6)) + 3 * rng.integers(0, 4, size=(4000, 1))
    x[:50] = x[50:100]  # rows that occur twice
    centres, moves, state, compared = x[:200].copy(), None, None, []
    full = knn._two_closest

    def counted(rows, *rest):
        compared.append(len(rows))
        return full(rows, *rest)

    monkeypatch.setattr(knn, "_two_closest", counted)
    for step in range(60):
        if state is None:
            state = knn._two_closest(x, centres, 1e-12)
        else:
            state = knn._after_moves(x, *state, centres, moves)
        near, beyond = state
        assert (near == knn._closest(x, centres)).all()
        d = np.sqrt(((x[:, None] - centres[None]) ** 2).sum(2))
        d[np.arange(len(x)), near] = np.inf
        assert (beyond <= d.min(axis=1) + 1e-9).all()
        n = np.bincount(near, minlength=200)
        new = np.stack([np.bincount(near, x[:, c], 200) for c in range(6)], 1) / np.maximum(n, 1)[:, None]
        new[n == 0] = centres[n == 0]
        moves, centres = np.sqrt(((new - centres) ** 2).sum(1)), new
    assert sum(compared) < 0.5 * 60 * len(x)
    assert sum(compared[-5:]) < len(x)


def test_kmeans_of_many_steps_is_lloyd(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 3))
    rows = spark.createDataFrame(pd.DataFrame({"vec": list(x)}), "vec array<double>").repartition(3)
    rows = rows.select(array_to_vector("vec").alias("z")).persist()
    centres = np.array(KMeans(k=12, seed=5, featuresCol="z", maxIter=0).fit(rows).clusterCenters())
    steps, moved = 0, True
    while moved and steps < 70:
        near = knn._closest(x, centres)
        new = np.array([x[near == i].mean(0) for i in range(12)])
        moved = (((new - centres) ** 2).sum(1) > 1e-8).any()
        centres, steps = new, steps + 1
    assert steps > 2 * knn._COMPARED_ANEW
    for carried in (0, 1e18):
        monkeypatch.setattr(knn, "_PRODUCTS_CARRIED", carried)
        ours = knn.cluster(rows, "z", 12, 5, 70)
        assert ours.steps == steps
        np.testing.assert_allclose(ours.centres, centres, atol=1e-9)
