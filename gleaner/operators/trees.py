"""Gradient boosted trees, grown leaf by leaf on binned columns.

Labels are few and vectors are wide. Columns are binned first, a task for each group of
columns; then a task grows the trees of one fit on a byte for each value, so several fits
(folds, and the final one) advance in the same job. A fit whose bytes are too many for a task
is dealt by columns to several: each proposes the best split of its columns, and the one
whose proposal wins sends which rows go right. They meet at barriers, which take about a
second each; only where a pass over the rows takes as long is this the quicker way.
"""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import vectors
from gleaner.operators.params import EnsembleParams, boosting_rounds
from gleaner.session import packed, staged

#: Most bins of a column, least sum of second derivatives in a leaf.
MAX_BINS = 255
MIN_HESSIAN = 1e-3
# Bytes (rows times columns of a fit) from which a fit is dealt to one more task.
_BYTES_PER_TASK = 5e8
# Values (rows times columns) that a task bins.
_BINNED_PER_TASK = 2e6
# Rows from which sums go column by column; fewer rows of many columns are summed at once.
_ROWS_BY_COLUMN = 4096
# Rows scored together, times trees.
_SCORED_AT_ONCE = 1 << 19
_MODEL_SCHEMA = "fit int, init double, tree int, leaf array<int>, column array<int>, threshold array<double>, value array<double>"


@dataclass
class TreesModel:
    """Boosted trees as arrays (tree, split) and (tree, leaf).

    Split ``k`` of a tree sends rows of leaf ``leaf[k]`` whose ``column[k]`` is above
    ``threshold[k]`` to the new leaf ``k + 1``; unused splits have column -1.
    """

    init: float
    leaf: np.ndarray
    column: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    n_features: int

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for each row of ``x``."""
        out = np.full(len(x), self.init)
        n_trees, n_splits = self.column.shape
        if not n_trees:
            return out
        column = np.maximum(self.column, 0)
        threshold = np.where(self.column < 0, np.inf, self.threshold)
        step = max(1, _SCORED_AT_ONCE // n_trees)
        for first in range(0, len(x), step):
            part = np.ascontiguousarray(x[first : first + step].T)
            at = np.zeros((n_trees, part.shape[1]), dtype=np.int8)
            for k in range(n_splits):
                right = part[column[:, k]] > threshold[:, k, None]
                right &= at == self.leaf[:, k, None]
                at[right] = k + 1
            out[first : first + step] += np.take_along_axis(self.value, at, axis=1).sum(axis=0)
        return out

    def predict(self, df: DataFrame, vec: str = "vec", out: str = "p_gbt") -> DataFrame:
        """Add the probability of class 1, null for rows without a vector."""
        shared = df.sparkSession.sparkContext.broadcast(self)
        width = self.n_features

        # The same kind of UDF as the other members': Spark cannot mix kinds in one projection.
        @F.pandas_udf("double")
        def probability(column: pd.Series) -> pd.Series:
            x = np.stack(column.to_numpy()) if len(column) else np.empty((0, width))
            return pd.Series(1 / (1 + np.exp(-shared.value.raw_scores(x))))

        filled = vectors.or_zeros(vectors.as_doubles(vec), width)
        return df.withColumn(out, vectors.blank_without(vec, probability(filled)))

    def table(self, spark: SparkSession) -> DataFrame:
        """A row for each tree, for saving."""
        rows = [
            (0, self.init, t, *(a[t].tolist() for a in (self.leaf, self.column, self.threshold, self.value)))
            for t in range(len(self.column))
        ]
        return spark.createDataFrame(rows, _MODEL_SCHEMA)


def from_rows(rows: list, n_features: int) -> TreesModel:
    """The model of one fit from its rows of trees."""
    rows = sorted(rows, key=lambda r: r["tree"])
    stack = lambda name, kind: np.array([r[name] for r in rows], dtype=kind)
    return TreesModel(
        rows[0]["init"], stack("leaf", np.int8), stack("column", np.int32),
        stack("threshold", float), stack("value", float), n_features,
    )


# --- one fit --------------------------------------------------------------------------


def bin_edges(x: np.ndarray) -> np.ndarray:
    """Upper edges of a column's bins, but for the last: between neighbouring values.

    Up to ``MAX_BINS`` distinct values have a bin each; more are cut into as equal counts as
    whole values allow.
    """
    values, counts = np.unique(x, return_counts=True)
    middle = (values[:-1] + values[1:]) / 2
    # Between two neighbouring doubles there is no middle; the lower one then is the edge.
    middle = np.where(middle >= values[1:], values[:-1], middle)
    if len(values) <= MAX_BINS:
        return middle
    ends = np.cumsum(counts)[:-1]
    wanted = np.arange(1, MAX_BINS) * (len(x) / MAX_BINS)
    return middle[np.unique(np.clip(np.searchsorted(ends, wanted), 0, len(middle) - 1))]


def draw(key: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A pseudorandom 64-bit number for each key, different in every tree."""
    mixed = (seed * 0x9E3779B97F4A7C15 + (tree + 1) * 0xD6E8FEB86659FD93) % (1 << 64)
    x = key.astype(np.uint64) ^ np.uint64(mixed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def _lowest(numbers: np.ndarray, share: float) -> np.ndarray:
    """Places of the lowest share of some numbers, at least one, in order.

    Of equal numbers the first ones count.
    """
    n = min(len(numbers), max(1, math.floor(share * len(numbers) + 0.5)))
    if not n:
        return np.empty(0, np.int64)
    most = np.partition(numbers, n - 1)[n - 1]
    taken = numbers < most
    taken[np.flatnonzero(numbers == most)[: n - np.count_nonzero(taken)]] = True
    return np.flatnonzero(taken)


@dataclass
class _Leaf:
    sums: np.ndarray  # (kind, column, bin): first and second derivatives, counts
    gain: float = -math.inf
    column: int = -1
    edge: int = -1


class Growth:
    """Grows the trees of one fit on the columns of one task.

    ``codes`` has the bins of the own columns (a row each), ``edges`` their edges, ``columns``
    their numbers among all; ``best_of`` and ``right_of`` agree with the tasks that hold the
    others. ``key`` tells rows apart, whatever their order.
    """

    def __init__(
        self,
        codes: np.ndarray,
        edges: list[np.ndarray],
        y: np.ndarray,
        key: np.ndarray,
        columns: np.ndarray,
        n_features: int,
        params: EnsembleParams,
        best_of: Callable[[list[tuple]], list[tuple]] = lambda own: own,
        right_of: Callable[[np.ndarray | None], np.ndarray] = lambda own: own,
    ) -> None:
        self.codes, self.edges, self.y, self.key = codes, edges, y, key
        self.columns, self.n_features = columns, n_features
        self.params, self.best_of, self.right_of = params, best_of, right_of
        self.rounds, self.rate = boosting_rounds(params)
        self.bins = 1 + max((len(e) for e in edges), default=0)

    def _sums(self, codes: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """First and second derivatives and counts by column and bin; ``codes`` has a row a column."""
        if codes.shape[1] >= _ROWS_BY_COLUMN:
            out = np.empty((3, len(codes), self.bins))
            for c, own in enumerate(codes):
                at = own.astype(np.intp)
                out[0, c] = np.bincount(at, first, self.bins)
                out[1, c] = np.bincount(at, second, self.bins)
                out[2, c] = np.bincount(at, minlength=self.bins)
            return out
        flat = (codes + (np.arange(len(codes)) * self.bins)[:, None]).reshape(-1)
        size = len(codes) * self.bins
        weigh = lambda w: np.bincount(flat, weights=np.tile(w, len(codes)), minlength=size)
        counts = np.bincount(flat, minlength=size)
        return np.array([weigh(first), weigh(second), counts]).reshape(3, len(codes), self.bins)

    def _best(self, leaf: _Leaf, chosen: np.ndarray) -> tuple:
        """(gain, -column, edge, number among the chosen) of the best split of a leaf."""
        if not len(chosen) or self.bins < 2:
            return (-math.inf, 0, -1, -1)
        left = leaf.sums.cumsum(axis=2)
        total = left[:, :, -1:]
        right = total - left
        least = self.params.trees.min_data_in_leaf
        fits = (left[2] >= least) & (right[2] >= least) & (left[1] >= MIN_HESSIAN) & (right[1] >= MIN_HESSIAN)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[0] ** 2 / left[1] + right[0] ** 2 / right[1] - total[0] ** 2 / total[1]
        gain = np.where(fits, gain, -math.inf)
        place = int(gain.argmax())
        c, edge = divmod(place, self.bins)
        return (float(gain[c, edge]), -int(self.columns[chosen[c]]), edge, c)

    def _tree(self, tree: int, score: np.ndarray) -> tuple[list, list, list, np.ndarray, np.ndarray]:
        trees = self.params.trees
        p = 1 / (1 + np.exp(-score))
        first, second = p - self.y, p * (1 - p)
        # What the sums need of the sampled rows and columns is gathered once a tree.
        bag = _lowest(draw(self.key, trees.seed, tree), trees.row_sample)
        first, second = first[bag], second[bag]
        every = np.arange(self.n_features, dtype=np.uint64)
        sampled = _lowest(draw(every, trees.seed + 1, tree), trees.column_sample)
        chosen = np.flatnonzero(np.isin(self.columns, sampled))
        codes = np.empty((len(chosen), len(bag)), dtype=self.codes.dtype)
        for i, c in enumerate(chosen):
            self.codes[c].take(bag, out=codes[i], mode="clip")
        at = np.zeros(len(self.y), dtype=np.int8)
        leaves = [_Leaf(self._sums(codes, first, second))]
        fresh = [0]
        parents, columns, thresholds = [], [], []
        for k in range(trees.num_leaves - 1):
            own = [self._best(leaves[i], chosen) for i in fresh]
            agreed = self.best_of([o[:2] for o in own])
            for i, mine, (gain, column) in zip(fresh, own, agreed, strict=True):
                leaves[i].gain, leaves[i].column = gain, -column
                is_mine = mine[0] == gain and mine[1] == column and gain > -math.inf
                leaves[i].edge = mine[2] if is_mine else -1
            split = max(range(len(leaves)), key=lambda i: (leaves[i].gain, -i))
            leaf = leaves[split]
            if leaf.gain <= 0:
                # Other fits in the job may go on: take part in what they agree on.
                for _ in range(k, trees.num_leaves - 1):
                    self.right_of(None)
                    self.best_of([])
                break
            threshold, above = None, None
            if leaf.edge >= 0:
                own_column = int(np.flatnonzero(self.columns == leaf.column)[0])
                threshold = float(self.edges[own_column][leaf.edge])
                above = self.codes[own_column] > leaf.edge
            threshold, above = self.right_of(None if above is None else (threshold, above))
            right = (at == split) & above
            at[right] = k + 1
            parents.append(split)
            columns.append(leaf.column)
            thresholds.append(threshold)
            # The smaller side is summed up, the other is what is left.
            of_bag = at[bag]
            sides = np.flatnonzero(of_bag == split), np.flatnonzero(of_bag == k + 1)
            small = int(len(sides[1]) < len(sides[0]))
            rows = sides[small]
            sums = self._sums(codes[:, rows], first[rows], second[rows])
            both = {small: sums, 1 - small: leaf.sums - sums}
            leaves[split] = _Leaf(both[0])
            leaves.append(_Leaf(both[1]))
            fresh = [split, k + 1]
        else:
            self.best_of([])
        value = np.zeros(trees.num_leaves)
        n = len(parents) + 1
        if n > 1:
            of_bag = at[bag]
            for i in range(n):
                rows = of_bag == i
                value[i] = -self.rate * first[rows].sum() / second[rows].sum()
        return parents, columns, thresholds, value, value[at]

    def run(self) -> tuple[float, dict[str, np.ndarray]]:
        """The log odds of the class shares, and the trees as arrays."""
        splits = self.params.trees.num_leaves - 1
        share = np.clip(self.y.mean() if len(self.y) else 0.5, 1e-15, 1 - 1e-15)
        init = float(np.log(share / (1 - share)))
        score = np.full(len(self.y), init)
        out = {
            "leaf": np.zeros((self.rounds, splits), np.int8),
            "column": np.full((self.rounds, splits), -1, np.int32),
            "threshold": np.zeros((self.rounds, splits)),
            "value": np.zeros((self.rounds, splits + 1)),
        }
        for tree in range(self.rounds):
            parents, columns, thresholds, value, gained = self._tree(tree, score)
            n = len(parents)
            out["leaf"][tree, :n], out["column"][tree, :n] = parents, columns
            out["threshold"][tree, :n], out["value"][tree] = thresholds, value
            score = score + gained
        return init, out


# --- many fits in one job -------------------------------------------------------------


def _agreement(context: BarrierTaskContext, own: range) -> tuple[Callable, Callable]:
    """How the tasks of a fit (partitions ``own``) agree, while all tasks of the job meet."""

    def best_of(proposals: list[tuple]) -> list[tuple]:
        told = [json.loads(m) for m in context.allGather(json.dumps(proposals))]
        return [max(tuple(p) for p in of_leaf) for of_leaf in zip(*(told[i] for i in own), strict=True)]

    def right_of(mine: tuple | None) -> tuple | None:
        text = ""
        if mine is not None:
            text = json.dumps([mine[0], base64.b64encode(np.packbits(mine[1])).decode(), len(mine[1])])
        told = context.allGather(text)
        for i in own:
            if told[i]:
                threshold, bits, n = json.loads(told[i])
                return threshold, np.unpackbits(np.frombuffer(base64.b64decode(bits), np.uint8), count=n).astype(bool)
        return None

    return best_of, right_of


def _tasks_per_fit(spark: SparkSession, n: int, width: int, n_fits: int) -> int:
    """How many tasks share the columns of a fit; all tasks of the job must run at once."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 1  # barriers need a fixed number of executors
    slots = spark.sparkContext.defaultParallelism
    return max(1, min(math.ceil(n * width / _BYTES_PER_TASK), slots // n_fits, width))


def _blocks(batches: Iterator[pa.RecordBatch]) -> list[dict]:
    return [block for batch in batches for block in batch.to_pylist()]


def _binned(rows: DataFrame, n_fits: int, groups: list[np.ndarray], per_fit: list[np.ndarray]) -> DataFrame:
    """(slot, first, codes, edges, y, key): the binned columns of every fit.

    ``groups`` are the columns that a task bins, ``per_fit`` those of each task of a fit. The
    rows of a fit are in the order of key and label, so sums do not depend on how they arrived
    and all tasks of a fit agree; rows with the same key are the same row twice.
    """
    width = sum(map(len, groups))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("vec").flatten().to_numpy().reshape(batch.num_rows, width)
            y, key = (batch.column(c).to_numpy() for c in ("label", "key"))
            members = batch.column("fits")
            row = np.repeat(np.arange(batch.num_rows), members.value_lengths().to_numpy())
            member = np.zeros((n_fits, batch.num_rows), dtype=bool)
            member[members.flatten().to_numpy(), row] = True
            for g, columns in enumerate(groups):
                blocks = (np.ascontiguousarray(x[:, columns].T), y, key, member)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g], pa.int32()), *(pa.array([b.tobytes()], pa.binary()) for b in blocks)],
                    names=["part", "x", "y", "key", "member"],
                )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks(batches)
        if not blocks:
            return
        columns = groups[blocks[0]["part"]]
        y, key = (np.concatenate([np.frombuffer(b[c], k) for b in blocks]) for c, k in (("y", float), ("key", np.int64)))
        x = np.concatenate([np.frombuffer(b["x"]).reshape(len(columns), -1) for b in blocks], axis=1)
        member = np.concatenate([np.frombuffer(b["member"], bool).reshape(n_fits, -1) for b in blocks], axis=1)
        order = np.lexsort((y, key))
        for fit in range(n_fits):
            own = order[member[fit][order]]
            for g, theirs in enumerate(per_fit):
                mine = np.flatnonzero(np.isin(columns, theirs))
                if not len(own) or not len(mine):
                    continue
                edges = [bin_edges(x[c, own]) for c in mine]
                codes = [np.searchsorted(e, x[c, own]).astype(np.uint8).tobytes() for e, c in zip(edges, mine, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([fit * len(per_fit) + g], pa.int32()),
                        pa.array([int(columns[mine[0]])], pa.int32()),
                        pa.array([b"".join(codes)], pa.binary()),
                        pa.array([[e.tolist() for e in edges]], pa.list_(pa.list_(pa.float64()))),
                        pa.array([y[own].tobytes()], pa.binary()),
                        pa.array([key[own].tobytes()], pa.binary()),
                    ],
                    names=["slot", "first", "codes", "edges", "y", "key"],
                )

    dealt = rows.mapInArrow(deal, "part int, x binary, y binary, key binary, member binary")
    dealt = dealt.repartitionById(len(groups), F.col("part"))
    return dealt.mapInArrow(cut, "slot int, first int, codes binary, edges array<array<double>>, y binary, key binary")


def fit_many(
    df: DataFrame,
    params: EnsembleParams,
    n_fits: int,
    fits: str = "fits",
    vec: str = "vec",
    label: str = "label",
    tasks_per_fit: int | None = None,
) -> list[TreesModel]:
    """One model for each fit: fit ``i`` learns from the rows whose array ``fits`` has ``i``.

    A model is the same as that of a fit by itself, in whatever order the rows come and by
    however many tasks. Rows without a vector or a label are left out. A task holds a byte for
    each row and column of a fit (and eight for each row of a group of columns while these are
    binned): 27 MB at 4,000 labels of 6,784 columns. From 500 MB on the columns are dealt to
    more tasks.
    """
    spark = df.sparkSession
    rows = vectors.with_vector(df, vec, label).select(
        vectors.as_doubles(vec).alias("vec"),
        F.col(label).cast("double").alias("label"),
        F.col(fits).cast("array<int>").alias("fits"),
    )
    rows = staged(rows.withColumn("key", F.xxhash64("vec", "label")), "boosting_rows")
    size = rows.agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("width"), F.max(F.size("vec")).alias("top")).first()
    if not size.n:
        raise ValueError("no rows with a vector and a label to fit trees on")
    if size.width != size.top:
        raise ValueError(f"vectors of widths {size.width} to {size.top}")
    width = size.width
    per_fit = np.array_split(np.arange(width), tasks_per_fit or _tasks_per_fit(spark, size.n, width, n_fits))
    tasks = len(per_fit)
    together = max(1, min(width, math.ceil(size.n * width / _BINNED_PER_TASK)))
    groups = np.array_split(np.arange(width), together)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = sorted(_blocks(batches), key=lambda b: b["first"])
        if not blocks and tasks == 1:
            return
        slot, agree = blocks[0]["slot"] if blocks else -1, {}
        if tasks > 1:
            context = BarrierTaskContext.get()
            slot = context.partitionId()
            first = slot // tasks * tasks
            agree = dict(zip(("best_of", "right_of"), _agreement(context, range(first, first + tasks)), strict=True))
        fit, group = divmod(slot, tasks)
        columns = per_fit[group]
        y, key = (np.frombuffer(blocks[0][c], k) if blocks else np.empty(0, k) for c, k in (("y", float), ("key", np.int64)))
        codes = np.frombuffer(b"".join(b["codes"] for b in blocks), np.uint8).reshape(len(columns), len(y))
        edges = [np.array(e) for b in blocks for e in b["edges"]] or [np.empty(0)] * len(columns)
        init, found = Growth(codes, edges, y, key, columns, width, params, **agree).run()
        if group:
            return
        n = len(found["column"])
        kinds = (("leaf", pa.int32()), ("column", pa.int32()), ("threshold", pa.float64()), ("value", pa.float64()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([fit] * n, pa.int32()),
                pa.array([init] * n),
                pa.array(range(n), pa.int32()),
                *(pa.array(list(found[c]), pa.list_(k)) for c, k in kinds),
            ],
            names=["fit", "init", "tree", *(c for c, _ in kinds)],
        )

    binned = _binned(packed(rows, size.n * width, _BINNED_PER_TASK), n_fits, groups, per_fit)
    dealt = binned.repartitionById(n_fits * tasks, F.col("slot"))
    grown = staged(dealt.mapInArrow(grow, _MODEL_SCHEMA, barrier=tasks > 1), "trees")
    found: dict[int, list] = {i: [] for i in range(n_fits)}
    # As many rows as fits have trees.
    for row in grown.collect():
        found[row["fit"]].append(row)
    missing = [i for i, rows in found.items() if not rows]
    if missing and boosting_rounds(params)[0]:
        raise ValueError(f"no rows to fit {missing} on")
    return [from_rows(found[i], width) for i in range(n_fits)]


def fit_trees(
    df: DataFrame, params: EnsembleParams, vec: str = "vec", label: str = "label"
) -> TreesModel:
    """Boosted trees of at most ``num_leaves`` leaves, the best leaf split first.

    Rows without a vector or a label are left out.
    """
    return fit_many(df.withColumn("fits", F.array(F.lit(0))), params, 1, "fits", vec, label)[0]
