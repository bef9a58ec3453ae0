"""Exact top-k search by inner product with cover trees over queries and data.

Vectors gather around pivots; the rows of a pivot are cut into blocks of bounded size and a
task builds a cover tree for each block, queries and data apart. A node's children are centred
on points more than half the node's radius apart and hold all points within that distance of
their centre, down to leaves. A pair of nodes (queries Q, data D) with centres ``q``, ``d`` and
covering radii ``r``, ``s`` holds no score above

    q.d + r |d| + s |q| + r s

and is left out when that is below the worst k-th score of the queries in Q so far.

Blocks are searched in two rounds. In the first a block of queries meets the blocks of data
whose centres score highest with its queries, which gives every query a k-th score. In the
second it meets only the other blocks whose root may hold more than that for one of its
queries; within a task, what is found in one block prunes the next.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import words
from gleaner.session import staged

#: Points of leaves that are scored at a time.
_SCORED_POINTS = 64
#: Roots of data blocks that a block of queries is compared with at a time.
_CHUNK = 4096


@dataclass(frozen=True)
class SearchParams:
    """``pivots`` bounds the table of pivots that every task holds; rows of a pivot beyond
    ``data_block`` (``query_block``) are cut by hash, so any number of rows is searched.
    Queries that differ do not share a leaf unless ``query_leaf`` lets them."""

    k: int = 10
    data_block: int = 4096
    query_block: int = 1024
    leaf: int = 32
    query_leaf: int = 1
    pivots: int = 1024


@dataclass
class CoverTree:
    """Points in tree order with, per node, its range, radius and children.

    The first point of a node's range is its centre.
    """

    rows: np.ndarray
    ids: np.ndarray
    points: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    n_children: np.ndarray

    @property
    def norms(self) -> np.ndarray:
        return np.linalg.norm(self.points.astype(float), axis=1)


def build(rows: np.ndarray, ids: np.ndarray, points: np.ndarray, leaf: int) -> CoverTree:
    """A cover tree over integer points; nodes of at most ``leaf`` points are not split.

    The root's centre is the point next to the mean, which keeps its radius small.
    """
    values = points.astype(float)
    order = np.arange(len(values))
    first = int(np.linalg.norm(values - values.mean(axis=0), axis=1).argmin())
    order[[0, first]] = order[[first, 0]]
    squares = np.einsum("ij,ij->i", values, values)
    begin, end, radius, child, n_children = [0], [len(order)], [0.0], [0], [0]
    todo = [0]
    while todo:
        node = todo.pop()
        a, b = begin[node], end[node]
        own = order[a:b]
        radius[node] = float(np.linalg.norm(values[own] - values[own[0]], axis=1).max()) * (1 + 1e-9)
        if b - a <= leaf or radius[node] == 0:
            continue
        child[node] = len(begin)
        at = a
        for group in _cover(values, squares, own.copy(), radius[node] / 2):
            order[at : at + len(group)] = group
            todo.append(len(begin))
            begin.append(at)
            end.append(at + len(group))
            radius.append(0.0)
            child.append(0)
            n_children.append(0)
            n_children[node] += 1
            at += len(group)
    arrays = [np.array(x) for x in (begin, end, radius, child, n_children)]
    return CoverTree(rows[order], ids[order], points[order], *arrays)


def _cover(
    values: np.ndarray, squares: np.ndarray, own: np.ndarray, scale: float
) -> Iterator[np.ndarray]:
    """Groups within ``scale`` of their first point, these further apart."""
    points, sizes = values[own], squares[own]
    left = np.ones(len(own), dtype=bool)
    for i in range(len(own)):
        if left[i]:
            near = left & (sizes + sizes[i] - 2 * (points @ points[i]) <= scale * scale)
            near[i] = False
            left &= ~near
            left[i] = False
            yield np.concatenate([own[i : i + 1], own[near]])


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 64 bits they stop at the ends of the range."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The best ``k`` of every query so far: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None) -> None:
        """``floor``: k-th scores known from elsewhere; nothing below them is kept."""
        self.k = k
        self.floor = np.full(n, -np.inf) if floor is None else floor
        self.score = np.zeros((n, k), dtype=np.int64)
        self.id, self.row = self.score.copy(), self.score.copy()
        self.count = np.zeros(n, dtype=np.int64)
        self.worst = self.floor.copy()
        #: Pairs of rows whose score was computed.
        self.scored = 0

    def offer(
        self, a: int, b: int, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, valid: np.ndarray
    ) -> None:
        """Scores of queries a..b against some rows; only ``valid`` ones count."""
        k = self.k
        use = valid & (score >= self.worst[a:b, None])
        if score.shape[1] > k:
            # What is below the k-th of these alone cannot stay; ties with it can.
            ranked = np.where(valid, score, np.iinfo(np.int64).min)
            use &= score >= np.partition(ranked, score.shape[1] - k, axis=1)[:, -k, None]
        query, place = np.nonzero(use)
        if not len(query):
            return
        own, old = np.nonzero(np.arange(k) < self.count[a:b, None])
        who = np.concatenate([query, own])
        all_score = np.concatenate([score[query, place], self.score[a:b][own, old]])
        all_id = np.concatenate([ids[place], self.id[a:b][own, old]])
        all_row = np.concatenate([rows[place], self.row[a:b][own, old]])
        order = np.lexsort((all_row, all_id, ~all_score, who))
        who = who[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        order, who, rank = order[rank < k], who[rank < k], rank[rank < k]
        for mine, every in ((self.score, all_score), (self.id, all_id), (self.row, all_row)):
            mine[a + who, rank] = every[order]
        self.count[a:b] = np.maximum(self.count[a:b], np.bincount(who, minlength=b - a))
        full = self.count[a:b] == k
        own_worst = np.where(full, self.score[a:b, -1].astype(float), -np.inf)
        self.worst[a:b] = np.maximum(self.floor[a:b], own_worst)


def _limits(
    scores: np.ndarray, r: np.ndarray, s: np.ndarray, q_norm: np.ndarray, d_norm: np.ndarray
) -> np.ndarray:
    """Highest score of node pairs from their centres' scores, radii and norms.

    Grown by what the scores and sums may be rounded by.
    """
    size = r[:, None] * (d_norm + s)[None, :] + q_norm[:, None] * s[None, :]
    return scores + (1 + 1e-9) * size + 1e-12 * q_norm[:, None] * d_norm[None, :]


def dual_search(queries: CoverTree, data: CoverTree, best: Best) -> None:
    """Adds the data's best rows for every query to ``best``, descending both trees."""
    q_norms, d_norms = queries.norms, data.norms
    q_values, d_values = queries.points.astype(float), data.points.astype(float)

    def score(q: int, positions: np.ndarray) -> None:
        a, b = int(queries.begin[q]), int(queries.end[q])
        rows = data.rows[positions]
        other = queries.rows[a:b, None] != rows[None, :]
        found = _inner(queries.points[a:b], data.points[positions])
        best.scored += found.size
        best.offer(a, b, found, data.ids[positions], rows, other)

    def worst(q: int) -> float:
        return float(best.worst[queries.begin[q] : queries.end[q]].min())

    def score_leaves(q: int, leaves: np.ndarray, limits: np.ndarray) -> None:
        """The points of the likeliest leaves first, until no other leaf can hold a better one."""
        while True:
            open_ = limits >= worst(q)
            leaves, limits = leaves[open_], limits[open_]
            if not len(leaves):
                return
            if len(leaves) > _SCORED_POINTS:
                first = np.argpartition(-limits, _SCORED_POINTS)[:_SCORED_POINTS]
            else:
                first = np.arange(len(leaves))
            first = first[np.argsort(-limits[first], kind="stable")]
            sizes = np.cumsum(data.end[leaves[first]] - data.begin[leaves[first]])
            first = first[: 1 + int(np.searchsorted(sizes, _SCORED_POINTS))]
            score(q, np.concatenate([np.arange(data.begin[c], data.end[c]) for c in leaves[first]]))
            kept = np.ones(len(leaves), dtype=bool)
            kept[first] = False
            leaves, limits = leaves[kept], limits[kept]

    def below(tree: CoverTree, node: int) -> np.ndarray:
        n = int(tree.n_children[node])
        return np.arange(tree.child[node], tree.child[node] + n) if n else np.array([node])

    heap: list[tuple[float, int, int, int]] = [(-np.inf, 0, 0, 0)]
    count = 0
    while heap:
        bound, _, q, d = heapq.heappop(heap)
        if -bound < worst(q):
            continue
        qs, ds = below(queries, q), below(data, d)
        q_at, d_at = queries.begin[qs], data.begin[ds]
        limits = _limits(
            q_values[q_at] @ d_values[d_at].T, queries.radius[qs], data.radius[ds], q_norms[q_at], d_norms[d_at]
        )
        d_leaf = data.n_children[ds] == 0
        for i, sub in enumerate(qs.tolist()):
            later = ~d_leaf
            if queries.n_children[sub]:
                later = np.ones(len(ds), dtype=bool)
            else:
                score_leaves(sub, ds[d_leaf], limits[i, d_leaf])
            later &= limits[i] >= worst(sub)
            for c, limit in zip(ds[later].tolist(), limits[i, later].tolist(), strict=True):
                count += 1
                heapq.heappush(heap, (-limit, count, sub, c))


def vectors(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Staged (row, vec_id, point): components scaled to integers, unusable rows left out."""
    value = F.col(embedding)
    usable = value.isNotNull() & F.forall(
        value,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")),
    )
    point = F.transform(value, lambda x: F.floor(F.lit(1024.0) * x.cast("double")))
    rows = table.select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), value.alias(embedding)
    ).where(usable & F.col("vec_id").isNotNull())
    return staged(rows.select("row", "vec_id", point.alias("point")), "vectors")


def _matrix(points: pd.Series, width: int, dtype: type = np.int64) -> np.ndarray:
    """Points as rows; shorter ones are padded with zeros."""
    matrix = np.zeros((len(points), width), dtype=dtype)
    for i, p in enumerate(points):
        matrix[i, : len(p)] = p
    return matrix


def _pivots(rows: DataFrame, most: int, width: int) -> np.ndarray:
    """At most ``most`` points, drawn by hash."""
    drawn = rows.select("point", F.xxhash64("row").alias("draw")).orderBy("draw").limit(most)
    return _matrix(drawn.select("point").toPandas()["point"], width, float)


def _trees(rows: DataFrame, size: int, leaf: int, width: int, pivots: int) -> tuple[DataFrame, int]:
    """Staged (block, centre, radius, tree), and the number of blocks.

    A block holds rows next to one pivot; rows of a pivot beyond ``size`` are cut by hash.
    """
    centres = _pivots(rows, min(max(1, -(-rows.count() // size)), pivots), width)
    halves = np.einsum("ij,ij->i", centres, centres) / 2

    @F.pandas_udf("int")
    def nearest(points: pd.Series) -> pd.Series:
        found = _matrix(points, width, float) @ centres.T - halves
        return pd.Series(found.argmax(axis=1).astype(np.int32))

    celled = staged(rows.withColumn("cell", nearest("point")), "cells")
    # One row a pivot, so at most ``pivots``.
    sizes = celled.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("parts"))
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    blocked = celled.join(F.broadcast(sizes), "cell").select(
        "row", "vec_id", "point", (F.col("cell").cast("long") * F.lit(1 << 32) + part).alias("block")
    )

    def plant(group: pd.DataFrame) -> pd.DataFrame:
        points = _matrix(group["point"], width)
        tree = build(group["row"].to_numpy(), group["vec_id"].to_numpy(), points, leaf)
        return pd.DataFrame(
            {
                "block": [group["block"].iloc[0]],
                "centre": [tree.points[0].astype(float)],
                "radius": [float(tree.radius[0])],
                "tree": [pickle.dumps(tree)],
            }
        )

    schema = "block long, centre array<double>, radius double, tree binary"
    trees = staged(blocked.groupBy("block").applyInPandas(plant, schema), "trees")
    return trees, trees.count()


def _distinct_enough(rows: DataFrame, k: int) -> DataFrame:
    """Rows without those that ``k + 1`` equal points with smaller (vec_id, row) rank before.

    These cannot be among the best ``k`` of any query. Spark cuts each group before its
    shuffle, so a large group of copies does not meet in one task.
    """
    order = Window.partitionBy("point").orderBy("vec_id", "row")
    return rows.withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= k + 1).drop("copy")


def _visits(queries: DataFrame, data: DataFrame, n_blocks: int, first: bool) -> DataFrame:
    """(query_block, block): the blocks of data that a block of queries has to meet.

    ``first``: for every query, the block whose centre scores highest, of each chunk of
    roots. Otherwise all blocks whose root may hold a score not below the ``floor`` of a query.
    """
    n_chunks = -(-n_blocks // _CHUNK)
    root = F.struct("block", "centre", "radius")
    chunk = F.pmod(F.xxhash64("block"), F.lit(n_chunks)).cast("int").alias("chunk")
    roots = data.select(chunk, root.alias("root")).groupBy("chunk").agg(F.collect_list("root").alias("roots"))
    columns = ["query_block", "query_tree"] if first else ["query_block", "query_tree", "floors"]
    asked = queries.select(*columns, F.explode(F.sequence(F.lit(0), F.lit(max(n_chunks, 1) - 1))).alias("chunk"))
    schema = pa.schema([("query_block", pa.int64()), ("block", pa.int64())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree = pickle.loads(batch.column("query_tree")[i].as_py())
                table = batch.column("roots")[i].values
                centre = np.stack(table.field("centre").to_numpy(zero_copy_only=False))
                values = tree.points.astype(float)
                scores = values @ centre.T
                if first:
                    use = np.unique(scores.argmax(axis=1))
                else:
                    radius = table.field("radius").to_numpy()
                    norms = np.linalg.norm(centre, axis=1)
                    limits = _limits(scores, np.zeros(len(values)), radius, tree.norms, norms)
                    floor = _floor(tree, batch.column("floors")[i].values)
                    use = np.flatnonzero((limits >= floor[:, None]).any(axis=0))
                block = table.field("block").to_numpy()[use]
                yield words.record(schema, np.repeat(batch.column("query_block")[i].as_py(), len(use)), block)

    met = asked.join(roots, "chunk").select(*columns, "roots")
    return met.mapInArrow(meet, "query_block long, block long")


def _floor(tree: CoverTree, floors: pa.StructArray) -> np.ndarray:
    """The k-th score known for every query of a tree, in its order."""
    floor = np.full(len(tree.rows), -np.inf)
    known = floors.field("query_row").to_numpy()
    order = np.argsort(tree.rows)
    floor[order[np.searchsorted(tree.rows, known, sorter=order)]] = floors.field("score").to_numpy()
    return floor


def _search(
    visits: DataFrame, queries: DataFrame, data: DataFrame, k: int, scored: Accumulator | None
) -> DataFrame:
    """(query_block, query_row, query_id, row, vec_id, score) found in the visited blocks.

    Only a query's tree moves to the blocks it visits.
    """
    meet = (
        visits.join(queries.drop("centre", "radius"), "query_block")
        .join(data.select("block", "tree"), "block")
        .sortWithinPartitions("query_block")
    )
    names = ("query_block", "query_row", "query_id", "row", "vec_id", "score")
    schema = pa.schema([(n, pa.int64()) for n in names])
    has_floors = "floors" in queries.columns

    def results(block: int, tree: CoverTree, best: Best) -> pa.RecordBatch:
        if scored is not None:
            scored.add(best.scored)
        at, place = np.nonzero(np.arange(k) < best.count[:, None])
        found = (best.row[at, place], best.id[at, place], best.score[at, place])
        return words.record(schema, np.full(len(at), block), tree.rows[at], tree.ids[at], *found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, tree, best = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("query_block")[i].as_py() != block:
                    if best is not None:
                        yield results(block, tree, best)
                    block = batch.column("query_block")[i].as_py()
                    tree = pickle.loads(batch.column("query_tree")[i].as_py())
                    floor = _floor(tree, batch.column("floors")[i].values) if has_floors else None
                    best = Best(len(tree.rows), k, floor)
                dual_search(tree, pickle.loads(batch.column("tree")[i].as_py()), best)
        if best is not None:
            yield results(block, tree, best)

    return meet.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def top_k(
    table: DataFrame,
    is_query: Column,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    params: SearchParams | None = None,
    scored: Accumulator | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the best rows for each query row but the row itself.

    ``is_query`` is a condition on ``vec_id``. Components become ``floor(1024 * x)``. Rows
    whose id or vector is null, or whose vector holds a null or non-finite component, take no
    part; shorter vectors count as padded with zeros. Equal scores are ranked by the smaller
    id. Rows that repeat an id are rows of their own. Without rows the result is empty.

    ``scored`` is increased by the number of pairs of rows that are scored in leaves; tasks
    that run again count again.
    """
    params = params or SearchParams()
    k = params.k
    rows = vectors(table, vec_id, embedding)
    width = max(1, rows.agg(F.max(F.size("point"))).first()[0] or 0)
    data, n_blocks = _trees(_distinct_enough(rows, k), params.data_block, params.leaf, width, params.pivots)
    queries, _ = _trees(rows.where(is_query), params.query_block, params.query_leaf, width, params.pivots)
    queries = queries.withColumnsRenamed({"block": "query_block", "tree": "query_tree"})

    order = Window.partitionBy("query_block", "query_row").orderBy(F.desc("score"), "vec_id", "row")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    homes = staged(_visits(queries, data, n_blocks, True).distinct(), "homes")
    found = staged(ranked(_search(homes, queries, data, k, scored)), "found")
    floors = (
        found.where(F.col("rank") == k)
        .groupBy("query_block")
        .agg(F.collect_list(F.struct("query_row", "score")).alias("floors"))
    )
    none = F.array().cast("array<struct<query_row: bigint, score: bigint>>")
    asked = queries.join(floors, "query_block", "left").withColumn("floors", F.coalesce("floors", none))
    others = _visits(asked, data, n_blocks, False).join(homes, ["query_block", "block"], "left_anti")
    more = _search(others, asked, data, k, scored)
    return ranked(found.drop("rank").unionByName(more)).select("query_id", "rank", "vec_id", "score")
