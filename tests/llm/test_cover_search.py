import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import cover_search
from gleaner.llm.cover_search import SearchParams

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, k):
    usable = [
        (i, vid, [math.floor(1024 * float(np.float32(x))) for x in v])
        for i, (vid, v, _) in enumerate(rows)
        if vid is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, vid, q in usable:
        if vid % 10 == 0:
            scored = sorted(
                (-sum(a * b for a, b in zip(q, v, strict=False)), other) for j, other, v in usable if j != i
            )
            out += [(vid, rank + 1, other, -s) for rank, (s, other) in enumerate(scored[:k])]
    return sorted(out)


def make_rows(n, width, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    rows = []
    for i in range(n):
        v = centres[i % 5] + 0.3 * rng.normal(size=width)
        rows.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), i))
    return rows


@pytest.mark.parametrize("params", [SearchParams(), SearchParams(k=4, data_block=64, query_block=8, leaf=4)])
def test_equals_brute_force(spark, params):
    rows = make_rows(400, 12)
    rows += [(1000 + i, rows[7][1], 0) for i in range(30)]  # ties
    rows += [(20, rows[3][1], 0), (20, rows[20][1], 0)]  # repeated ids
    rows += [(50, None, 0), (60, [float("nan")] * 12, 0), (70, [None] * 12, 0), (None, rows[0][1], 0)]
    rows += [(80, [float("inf")] * 12, 0), (90, [], 0), (110, [0.5, 0.25], 0)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = cover_search.top_k(table, F.col("vec_id") % 10 == 0, params=params)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, params.k)


def test_fewer_rows_than_asked_for(spark):
    rows = make_rows(4, 3)
    got = cover_search.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0)
    assert [r["rank"] for r in got.orderBy("rank").collect()] == [1, 2, 3]


def test_empty_table(spark):
    assert cover_search.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 10 == 0).count() == 0


def test_tree_covers_its_points():
    rng = np.random.default_rng(3)
    points = rng.integers(-1000, 1000, size=(500, 6))
    tree = cover_search.build(np.arange(500), np.arange(500), points, 8)
    assert sorted(tree.rows.tolist()) == list(range(500))
    for a, b, r in zip(tree.begin, tree.end, tree.radius, strict=True):
        assert np.linalg.norm(tree.points[a:b] - tree.points[a], axis=1).max() <= r * (1 + 1e-9)
    children = [
        (tree.begin[c], tree.end[c])
        for i in np.flatnonzero(tree.n_children)
        for c in range(tree.child[i], tree.child[i] + tree.n_children[i])
    ]
    assert len(children) == len(tree.begin) - 1


def test_far_groups_are_pruned(monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16)) * 1000
    points = np.concatenate([c + rng.normal(size=(200, 16)) * 10 for c in centres]).astype(np.int64)
    data = cover_search.build(np.arange(1600), np.arange(1600), points, 16)
    queries = cover_search.build(np.arange(10), np.arange(10), points[:10], 16)
    scored = []
    plain = cover_search._inner
    monkeypatch.setattr(cover_search, "_inner", lambda a, b: scored.append(a.shape[0] * b.shape[0]) or plain(a, b))
    cover_search.dual_search(queries, data, cover_search.Best(10, 5))
    assert sum(scored) < 1600 * 10 / 2


def test_clusters_are_pruned_through_the_whole_search(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(50, 16))
    points = centres[rng.integers(0, 50, size=20_000)] + 0.01 * rng.normal(size=(20_000, 16))
    rows = [(i, p.astype(np.float32).tolist(), 0) for i, p in enumerate(points)]
    scored = spark.sparkContext.accumulator(0)
    table = spark.createDataFrame(rows, SCHEMA)
    params = SearchParams(data_block=1024, query_block=64)
    got = cover_search.top_k(table, F.col("vec_id") % 100 == 0, params=params, scored=scored)
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got.collect()}
    whole = np.floor(1024 * points.astype(np.float32).astype(float)).astype(np.int64)
    for q in range(0, 20_000, 100):
        score = whole @ whole[q]
        order = np.lexsort((np.arange(20_000), -score))
        best = order[order != q][:10]
        assert [found[q, r + 1] for r in range(10)] == [(int(i), int(score[i])) for i in best]
    assert len(found) == 2000
    assert scored.value < 200 * 20_000 / 10


def test_many_copies_keep_the_smallest_ids(spark):
    rows = [(i, [0.5, 0.25, 0.125], 0) for i in range(3000)] + [(3000 + i, [0.1, i / 100, 0.0], 0) for i in range(20)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    params = SearchParams(k=4, data_block=64, query_block=8, leaf=4)
    got = cover_search.top_k(table, F.col("vec_id") % 100 == 0, params=params)
    for r in got.collect():
        ids = [i for i in range(6) if i != r["query_id"]]
        assert r["query_id"] == 3000 or r["vec_id"] == ids[r["rank"] - 1]
    assert got.count() == 31 * 4


def test_large_components_stay_exact():
    a = np.array([[2**40, -3]], dtype=np.int64)
    assert cover_search._inner(a, a)[0, 0] == 2**63 - 1  # beyond 64 bits
    b = np.array([[2**30, 1]], dtype=np.int64)
    assert cover_search._inner(b, b)[0, 0] == 2**60 + 1
