"""Boosted trees against plain searches over all splits, and in all ways to deal the work."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from gleaner.operators import trees
from gleaner.operators.params import DEFAULT, TreeParams
from pyspark.sql import functions as F

SMALL = TreeParams(num_leaves=4, min_data_in_leaf=5, column_sample=0.5, row_sample=0.7)
PARAMS = replace(DEFAULT, trees=SMALL, boosting=(12, 0.3))
# Tasks that agree by barriers need about a second for each: few and small trees.
BRIEF = replace(DEFAULT, trees=replace(SMALL, num_leaves=3), boosting=(2, 0.3))


def make(n=160, width=9, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.5, size=n) > 0).astype(float)
    return x, y


def table(spark, x, y, fits):
    rows = pd.DataFrame({"sample_id": range(len(x)), "vec": list(x), "label": y, "fits": list(fits)})
    return spark.createDataFrame(rows, "sample_id long, vec array<double>, label double, fits array<int>").repartition(5)


def plain_tree(x, g, h, least, leaves, rate):
    """Best-first growth by trying every edge of every column of every leaf."""
    at = np.zeros(len(x), int)
    for k in range(leaves - 1):
        best = (0.0, None)
        for leaf in range(k + 1):
            rows = np.flatnonzero(at == leaf)
            for c in range(x.shape[1]):
                values = np.unique(x[rows, c])
                for low, high in zip(values[:-1], values[1:]):
                    left = rows[x[rows, c] <= low]
                    right = rows[x[rows, c] > low]
                    if min(len(left), len(right)) < least:
                        continue
                    part = lambda r: g[r].sum() ** 2 / h[r].sum()
                    gain = part(left) + part(right) - part(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, right)
        if best[1] is None:
            break
        at[best[1]] = k + 1
    value = np.array([-rate * g[at == i].sum() / h[at == i].sum() if (at == i).any() else 0 for i in range(leaves)])
    return value[at]


def test_steps_equal_a_search_of_all_splits():
    x, y = make()
    whole = replace(PARAMS, trees=replace(SMALL, column_sample=1.0, row_sample=1.0), boosting=(3, 0.3))
    key = np.arange(len(x))
    edges = [trees.bin_edges(c) for c in x.T]
    codes = np.array([np.searchsorted(e, c) for e, c in zip(edges, x.T)]).astype(np.uint8)
    init, found = trees.Growth(codes, edges, y, key, np.arange(9), 9, whole).run()
    model = trees.TreesModel(init, *(found[c] for c in ("leaf", "column", "threshold", "value")), 9)
    score = np.full(len(x), np.log(y.mean() / (1 - y.mean())))
    for _ in range(3):
        p = 1 / (1 + np.exp(-score))
        score = score + plain_tree(x, p - y, p * (1 - p), 5, 4, 0.3)
    np.testing.assert_allclose(model.raw_scores(x), score, atol=1e-9)


def test_samples_have_their_sizes_and_repeat():
    key = np.arange(1000)
    first, again = (trees._lowest(trees.draw(key, 1, 7), 0.35) for _ in range(2))
    assert len(first) == 350 and (first == again).all()
    other = trees._lowest(trees.draw(key, 1, 8), 0.35)
    assert 80 < len(np.intersect1d(first, other)) < 170


def test_edges_lie_between_values_and_cut_evenly():
    assert trees.bin_edges(np.array([3.0, 1.0, 1.0, 2.0])).tolist() == [1.5, 2.5]
    assert trees.bin_edges(np.array([5.0, 5.0])).tolist() == []
    near = np.array([1.0, np.nextafter(1.0, 2.0)])
    assert trees.bin_edges(near).tolist() == [1.0]
    many = np.random.default_rng(0).normal(size=20000)
    counts = np.bincount(np.searchsorted(trees.bin_edges(many), many))
    assert len(counts) <= trees.MAX_BINS and counts.max() < 1.2 * counts.mean()


def same(a, b):
    assert a.init == b.init
    for name in ("leaf", "column", "threshold"):
        assert (getattr(a, name) == getattr(b, name)).all()
    np.testing.assert_allclose(a.value, b.value, atol=1e-12)


@pytest.mark.parametrize("tasks", [1, 2])
def test_fits_of_folds_equal_separate_fits(spark, tasks, monkeypatch):
    """Two fits in one job, their columns in one task or dealt to two that agree by barriers."""
    monkeypatch.setattr(trees, "_BINNED_PER_TASK", 500)
    params = PARAMS if tasks == 1 else BRIEF
    x, y = make()
    fold = np.arange(len(x)) % 3
    fits = [[i for i in (0, 1) if fold[r] != i] for r in range(len(x))]
    together = trees.fit_many(table(spark, x, y, fits), params, 2, tasks_per_fit=tasks)
    for i in (0, 1):
        alone = table(spark, x[fold != i], y[fold != i], [[0]] * int((fold != i).sum()))
        same(together[i], trees.fit_trees(alone, params))


def test_fits_that_stop_early_do_not_hold_up_others(spark):
    """One fit has too few rows to split at all, while tasks of both meet at every barrier."""
    x, y = make()
    fits = [[0, 1] if r < 8 else [0] for r in range(len(x))]
    long, short = trees.fit_many(table(spark, x, y, fits), BRIEF, 2, tasks_per_fit=2)
    assert (short.column == -1).all() and (long.column >= 0).any()
    assert np.allclose(short.raw_scores(x), short.init)


def test_labels_of_one_class_repeats_and_wrong_widths(spark):
    x, y = make(40)
    one = trees.fit_trees(table(spark, x, np.ones(40), [[0]] * 40), PARAMS)
    assert (one.raw_scores(x) > 20).all()
    twice = np.concatenate([x, x]), np.concatenate([y, y])
    doubled = replace(PARAMS, trees=replace(SMALL, row_sample=1.0, min_data_in_leaf=10))
    plain = replace(PARAMS, trees=replace(SMALL, row_sample=1.0, min_data_in_leaf=5))
    a = trees.fit_trees(table(spark, *twice, [[0]] * 80), doubled)
    b = trees.fit_trees(table(spark, x, y, [[0]] * 40), plain)
    np.testing.assert_allclose(a.raw_scores(x), b.raw_scores(x), atol=1e-9)
    with pytest.raises(ValueError, match="no rows"):
        trees.fit_trees(table(spark, x, y, [[0]] * 40).where("label > 5"), PARAMS)
    odd = table(spark, x, y, [[0]] * 40).withColumn("vec", F.expr("if(sample_id = 3, slice(vec, 1, 2), vec)"))
    with pytest.raises(ValueError, match="widths 2 to 9"):
        trees.fit_trees(odd, PARAMS)


def test_scores_do_not_depend_on_batches(spark, monkeypatch):
    x, y = make()
    model = trees.fit_trees(table(spark, x, y, [[0]] * len(x)), PARAMS)
    whole = model.raw_scores(x)
    monkeypatch.setattr(trees, "_SCORED_AT_ONCE", 50)
    np.testing.assert_array_equal(model.raw_scores(x), whole)
    df = table(spark, x, y, [[0]] * len(x)).unionByName(
        spark.createDataFrame([(999, None, 1.0, [0])], "sample_id long, vec array<double>, label double, fits array<int>"))
    got = {r.sample_id: r.p_gbt for r in model.predict(df).collect()}
    assert got.pop(999) is None
    np.testing.assert_allclose([got[i] for i in range(len(x))], 1 / (1 + np.exp(-whole)))
    again = trees.from_rows(model.table(spark).collect(), 9)
    np.testing.assert_array_equal(again.raw_scores(x), whole)


def test_sums_by_column_equal_those_at_once(monkeypatch):
    """A large fit sums its rows in another way; trees and samples are the same."""
    rng = np.random.default_rng(12)
    n = 3000
    x = rng.normal(size=(n, 6)).round(1)
    y = (x[:, 0] + rng.normal(size=n) > 0).astype(float)
    edges = [trees.bin_edges(c) for c in x.T]
    codes = np.array([np.searchsorted(e, c) for e, c in zip(edges, x.T)], dtype=np.uint8)
    params = replace(DEFAULT, trees=TreeParams(min_data_in_leaf=20), boosting=(6, 0.2))
    key = rng.integers(0, 50, n)
    grown = []
    for least in (1, 10**9):
        monkeypatch.setattr(trees, "_ROWS_BY_COLUMN", least)
        grown.append(trees.Growth(codes, edges, y, key, np.arange(6), 6, params).run())
    assert grown[0][0] == grown[1][0]
    for name in grown[0][1]:
        np.testing.assert_array_equal(grown[0][1][name], grown[1][1][name])
    for share in (0.0, 0.35, 1.0):
        order = np.sort(np.argsort(key, kind="stable")[: max(1, int(share * n + 0.5))])
        np.testing.assert_array_equal(trees._lowest(key, share), order)
