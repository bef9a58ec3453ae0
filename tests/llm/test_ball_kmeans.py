import hashlib

import numpy as np
import pytest
from pyspark.errors import PySparkException

from gleaner.llm import ball_kmeans as bk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, code int"


def brute(points, entries):
    away = ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    return away.argmin(axis=1), away.min(axis=1)


def reference(rows, params):
    """Codes, errors and codebooks by comparing everything with everything."""
    kept = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    n = len(kept)
    points = np.array([r[1] for r in kept], dtype=object).reshape(n, params.parts, -1)
    books = points[: params.entries].transpose(1, 0, 2).copy()
    for step in range(params.rounds + 1):
        found = [brute(points[:, p], books[p]) for p in range(params.parts)]
        if step == params.rounds:
            break
        for p, (code, _) in enumerate(found):
            for e in set(code):
                own = points[code == e, p]
                books[p, e] = [int(x) // len(own) for x in own.sum(axis=0)]
    codes = ["".join(f"{found[p][0][i]:02x}" for p in range(params.parts)) for i in range(n)]
    errors = [int(sum(found[p][1][i] for p in range(params.parts))) for i in range(n)]
    return [(r[0], c, e) for r, c, e in zip(kept, codes, errors, strict=True)], books


@pytest.mark.parametrize("spread, before", [(3, "zero"), (40, "near"), (1000, "random")])
def test_reassign_equals_all_comparisons(spread, before):
    rng = np.random.default_rng(spread)
    entries = rng.integers(-spread, spread, (16, 4))
    entries[5] = entries[3]
    points = np.concatenate([rng.integers(-spread, spread, (400, 4)), entries])
    start = {"zero": np.zeros(416, int), "near": brute(points, entries + 1)[0], "random": rng.integers(0, 16, 416)}[before]
    code, best = bk.reassign(points, entries, start)
    expected = brute(points, entries)
    assert (code == expected[0]).all() and (best == expected[1]).all()


def test_balls_save_most_comparisons():
    rng = np.random.default_rng(0)
    centres = rng.integers(-4000, 4000, (16, 8))
    points = np.repeat(centres, 500, axis=0) + rng.integers(-300, 300, (8000, 8))
    code, _ = brute(points, centres)
    effort = bk.Effort()
    bk.reassign(points, centres, code, effort)
    assert effort.in_core > 0.9 * effort.parts
    assert effort.others < 0.05 * 15 * effort.parts


def test_whole_fit_equals_plain_kmeans(spark):
    rng = np.random.default_rng(7)
    base = np.round(rng.normal(size=(90, 8)), 1)
    rows = [(int(i), [float(x) for x in np.float32(v)], int(i) % 3 or None, "x", 1) for i, v in enumerate(base)]
    rows += [rows[4], (4, rows[5][1], 2, "x", 1), (None, rows[6][1], 1, "x", 1)]
    odd = [(200, None, 1, "x", 1), (201, [1.0, None] + [0.0] * 6, 1, "x", 1), (202, [float("nan")] * 8, 1, "x", 1)]
    odd += [(203, [float("inf")] + [0.0] * 7, 1, "x", 1)]
    params = bk.BallKMeansParams(parts=2, entries=5, rounds=3)
    whole = [(r[0], [int(np.floor(4096.0 * float(np.float32(x)))) for x in r[1]]) for r in rows]
    expected, books = reference(whole, params)
    coded = bk.compress(spark.createDataFrame(rows + odd, SCHEMA).repartition(5), params=params)
    out = bk.described(coded)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = [(r.vec_id, r.code, r.error) for r in out.collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    digest = hashlib.sha256(",".join(str(int(x)) for x in books.reshape(-1)).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in out.collect()} == {digest}
    assert sum(r.label_error for r in out.where("vec_id = 0").collect()) == sum(
        r.error for r in coded.rows.where("label is null").collect()
    )


def test_huge_components_stay_exact(spark):
    rows = [(i, [1e30 * (-1) ** i, float(i), 3e8 * i, 0.0], 1, "x", 1) for i in range(6)]
    params = bk.BallKMeansParams(parts=2, entries=3, rounds=2)
    top, bottom = (1 << 63) - 1, -(1 << 63)
    whole = [(r[0], [top if r[0] % 2 == 0 else bottom, 4096 * r[0], 4096 * int(np.float32(3e8 * r[0])), 0]) for r in rows]
    expected, _ = reference(whole, params)
    out = bk.described(bk.compress(spark.createDataFrame(rows, SCHEMA), params=params)).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in out) == sorted((i, c, min(e, top)) for i, c, e in expected)


def test_few_rows_none_and_wrong_widths(spark):
    params = bk.BallKMeansParams(parts=2, entries=16, rounds=2)
    none = spark.createDataFrame([], SCHEMA)
    assert bk.described(bk.compress(none, params=params)).collect() == []
    two = spark.createDataFrame([(1, [0.0, 1.0], None, "x", 1), (2, [0.0, 1.0], None, "x", 1)], SCHEMA)
    assert {(r.code, r.error, r.label_error) for r in bk.described(bk.compress(two, params=params)).collect()} == {("0000", 0, 0)}
    with pytest.raises(ValueError, match="cannot be cut"):
        bk.compress(two.withColumn("embedding", two.embedding.cast("array<float>")), params=bk.BallKMeansParams(parts=8))
    rows = [(i, [0.0, 1.0], None, "x", 1) for i in range(20)] + [(99, [0.0], None, "x", 1)]
    with pytest.raises((PySparkException, Exception), match="not 2 wide"):
        bk.compress(spark.createDataFrame(rows, SCHEMA), params=params).rows.collect()
