"""Search for the ensemble weights that classify out-of-fold scores best.

The score of a weight triple is AUC + accuracy / 2 + 2 * negative margin
+ 2 * (1 - positive margin).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import keys
from gleaner.operators import metrics, peaks
from gleaner.session import staged

MEMBERS = ("p_knn", "p_lr", "p_gbt")
WEIGHTS = ("w_knn", "w_lr", "w_gbt")
# Number of random triples and the smallest weight before normalising.
N_TRIPLES = 10_000
SMALLEST_WEIGHT = 0.03
# Most distinct rows of a class that a task takes at a time, 80 MB of scores.
BLOCK_ROWS = 2_000_000
_RESULT = (
    "weight_id long, w_knn double, w_lr double, w_gbt double, auc double, accuracy double, "
    "positive_margin double, negative_margin double, score double"
)


def _normalised(raw: DataFrame) -> DataFrame:
    total = F.col(WEIGHTS[0]) + F.col(WEIGHTS[1]) + F.col(WEIGHTS[2])
    return raw.select("weight_id", *[(F.col(w) / total).alias(w) for w in WEIGHTS])


def random_weights(spark: SparkSession, n: int = N_TRIPLES, seed: int = 0) -> DataFrame:
    """``n`` triples of ``0.03 + 0.97 * uniform``, normalised to sum 1."""
    spread = 1.0 - SMALLEST_WEIGHT
    raw = spark.range(n).select(
        F.col("id").alias("weight_id"),
        *[
            (F.lit(SMALLEST_WEIGHT) + F.lit(spread) * keys.uniform(seed, F.lit(w), "id")).alias(w)
            for w in WEIGHTS
        ],
    )
    return _normalised(raw)


def grid_weights(spark: SparkSession, parts: int = 10) -> DataFrame:
    """All triples of positive multiples of ``1 / parts`` that sum to 1."""
    triples = [
        (i, j, parts - i - j) for i in range(1, parts) for j in range(1, parts - i)
    ]
    rows = [(n, *[float(x) for x in t]) for n, t in enumerate(triples)]
    return _normalised(spark.createDataFrame(rows, ["weight_id", *WEIGHTS]))


def _scored(found: DataFrame) -> DataFrame:
    score = (
        F.col("auc")
        + F.lit(0.5) * F.col("accuracy")
        + F.lit(2.0) * F.col("negative_margin")
        + F.lit(2.0) * (F.lit(1.0) - F.col("positive_margin"))
    )
    return found.withColumn("score", score)


def _wins(pos: np.ndarray, n_pos: np.ndarray, neg: np.ndarray, n_neg: np.ndarray) -> int:
    """Twice the pairs in which the positive scores higher, a tie counting half."""
    order = np.argsort(neg)
    neg, upto = neg[order], np.concatenate([[0], np.cumsum(n_neg[order])])
    order = np.argsort(pos)
    pos, n_pos = pos[order], n_pos[order]
    beaten = upto[np.searchsorted(neg, pos, side="left")]
    reached = upto[np.searchsorted(neg, pos, side="right")]
    return int((n_pos * (beaten + reached)).sum())


def _peak_positions(height: np.ndarray) -> np.ndarray:
    """Middles of the interior flat or pointed maxima of a curve."""
    starts = np.flatnonzero(np.r_[True, height[1:] != height[:-1]])
    ends = np.r_[starts[1:], len(height)] - 1
    level = height[starts]
    inner = np.arange(1, len(level) - 1)
    top = inner[(level[inner] > level[inner - 1]) & (level[inner] > level[inner + 1])]
    return (starts[top] + ends[top]) // 2


def _judged(sums: np.ndarray) -> tuple[float | None, ...]:
    """AUC, accuracy and margins from a triple's sums over all rows."""
    wins, correct, cells = int(sums[0]), int(sums[1]), sums[2:].reshape(2, -1)
    n_pos, n_neg = (int(n) for n in cells.sum(axis=1))
    accuracy = correct / (n_pos + n_neg) if n_pos + n_neg else None
    if not n_pos or not n_neg:
        return None, accuracy, peaks.POSITIVE_FLOOR, peaks.NEGATIVE_CEILING
    grid = np.linspace(0, 1, metrics.SWEEP_POINTS)
    low_pos, low_neg = np.cumsum(cells[:, :-1], axis=1)
    baseline = metrics.RATIO_BASELINE
    up = ((n_pos - low_pos) / n_pos) / ((n_neg - low_neg) / n_neg + baseline)
    down = (low_neg / n_neg) / (low_pos / n_pos + baseline)
    above = _peak_positions(-np.abs(up - peaks.RATIO_TARGET))
    below = _peak_positions(-np.abs(down - peaks.RATIO_TARGET))
    return (
        wins / (2 * n_pos * n_neg),
        accuracy,
        max(peaks.POSITIVE_FLOOR, grid[above[0]]) if len(above) else peaks.POSITIVE_FLOOR,
        min(peaks.NEGATIVE_CEILING, grid[below[-1]]) if len(below) else peaks.NEGATIVE_CEILING,
    )


def weight_search(
    oof: DataFrame,
    weights: DataFrame | None = None,
    n: int = N_TRIPLES,
    seed: int = 0,
    max_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """AUC, accuracy, margins and score of every weight triple.

    ``oof`` has ``label`` and the member scores; rows with a null in any are left out, all
    others are judged. Equal rows are folded to counts and dealt into blocks of about
    ``max_rows`` of one class. A task takes a block of positives, one of negatives and some
    of the triples; wins, hits and cells of the sweep are whole numbers that add up by
    triple, so the result does not depend on the blocks. Only the triples are broadcast.
    With labels of one class the area and the score are null and the margins at their
    limits; without rows the accuracy is null too.
    """
    spark = oof.sparkSession
    if weights is None:
        weights = random_weights(spark, n, seed)
    triples = weights.select("weight_id", *WEIGHTS).toPandas()
    shared = spark.sparkContext.broadcast(
        (triples["weight_id"].to_numpy(), triples[list(WEIGHTS)].to_numpy(dtype=float))
    )
    known = oof.select("label", *MEMBERS).dropna()
    scores = [F.col(m).cast("double").alias(m) for m in MEMBERS]
    folded = staged(
        known.groupBy((F.col("label") == 1).alias("positive"), *scores).agg(F.count("*").alias("n")),
        "oof_counts",
    )
    distinct = {r["positive"]: r["count"] for r in folded.groupBy("positive").count().collect()}
    blocks = {k: max(1, -(-distinct.get(k, 0) // max_rows)) for k in (True, False)}
    parts = spark.sparkContext.defaultParallelism
    shares = max(1, min(len(triples), -(-parts // (blocks[True] * blocks[False]))))
    n_cells = metrics.SWEEP_POINTS + 1
    width = 2 + 2 * n_cells

    def dealt(positive: bool) -> DataFrame:
        own, other = ("i", "j") if positive else ("j", "i")

        def every(count: int) -> Column:
            return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

        return (
            folded.where(F.col("positive") == positive)
            .withColumn(own, F.pmod(F.xxhash64(*MEMBERS), F.lit(blocks[positive])).cast("int"))
            .withColumn(other, every(blocks[not positive]))
            .withColumn("share", every(shares))
            .select("i", "j", "share", *MEMBERS, "n")
        )

    def judge(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        i, j, share = (k.as_py() for k in key)
        sides = []
        for table in (left, right):
            members = np.array([table.column(m).to_numpy() for m in MEMBERS], dtype=float)
            sides.append((members.reshape(len(MEMBERS), -1), table.column("n").to_numpy().astype(np.int64)))
        grid = np.linspace(0, 1, metrics.SWEEP_POINTS)
        mine = np.arange(share, len(shared.value[0]), shares)
        sums = np.zeros((len(mine), width), dtype=np.int64)
        for out, w in zip(sums, shared.value[1][mine], strict=True):
            cells = out[2:].reshape(2, n_cells)
            p = [w[0] * m[0] + w[1] * m[1] + w[2] * m[2] for m, _ in sides]
            (_, n_pos), (_, n_neg) = sides
            out[0] = _wins(p[0], n_pos, p[1], n_neg)
            # Each block is counted once, whatever number of others it meets. Thresholds a
            # score does not exceed start at its grid position.
            if j == 0:
                out[1] += n_pos[p[0] > 0.5].sum()
                at = np.searchsorted(grid, p[0], side="left")
                cells[0] += np.bincount(at, weights=n_pos, minlength=n_cells).astype(np.int64)
            if i == 0:
                out[1] += n_neg[~(p[1] > 0.5)].sum()
                at = np.searchsorted(grid, p[1], side="left")
                cells[1] += np.bincount(at, weights=n_neg, minlength=n_cells).astype(np.int64)
        packed = [row.tobytes() for row in sums]
        return pa.table({"triple": pa.array(mine, pa.int64()), "sums": pa.array(packed, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]

        def record(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            at = np.array([t for t, _ in found], dtype=np.int64)
            judged = [_judged(sums) for _, sums in found]
            columns = [pa.array(shared.value[0][at], pa.int64())]
            columns += [pa.array(shared.value[1][at, k], pa.float64()) for k in range(len(WEIGHTS))]
            columns += [pa.array([f[k] for f in judged], pa.float64()) for k in range(4)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        last: tuple[int, np.ndarray] | None = None
        for batch in batches:
            whole = []
            pairs = zip(batch.column("triple").to_pylist(), batch.column("sums").to_pylist(), strict=True)
            for triple, sums in pairs:
                if last is None or last[0] != triple:
                    whole += [last] if last else []
                    last = (triple, np.zeros(width, dtype=np.int64))
                if sums is not None:
                    last[1][:] += np.frombuffer(sums, dtype=np.int64)
            yield record(whole)
        if last:
            yield record([last])

    key = ("i", "j", "share")
    met = dealt(True).groupBy(*key).cogroup(dealt(False).groupBy(*key))
    sums = met.applyInArrow(judge, "triple long, sums binary")
    # Every triple has a row, also if nothing is judged.
    none = spark.range(len(triples)).select(F.col("id").alias("triple"), F.lit(None).cast("binary").alias("sums"))
    spread = sums.unionByName(none).repartition(parts, "triple").sortWithinPartitions("triple")
    schema = _RESULT.rsplit(",", 1)[0]
    return _scored(spread.mapInArrow(run, schema))


def best_weights(searched: DataFrame) -> DataFrame:
    """The triple with the highest score; scores equal to nine digits go by number."""
    return searched.orderBy(F.round("score", 9).desc_nulls_last(), "weight_id").limit(1)
