"""Nearest-neighbour regression against a compressed set of templates.

Columns are compressed by principal components, rows by k-means; a prediction averages
the labels of the nearest cluster means.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import vectors
from gleaner.operators.params import KnnParams
from gleaner.session import packed

# Templates up to this size are broadcast in one piece; more come in several pieces.
_BROADCAST_BYTES = 64 << 20
_MATRIX_CELLS = 4 << 20
# Queries that meet a block of templates in one group.
_QUERIES_PER_GROUP = 50_000
# Products a task of one k-means step should take.
_PRODUCTS_PER_TASK = 2e7
# Sums of that many tasks go straight to the driver; more are added up in the executors.
_SUMS_COLLECTED = 64
# Squared movement of a centre below which it is at rest: that of Spark's k-means.
_AT_REST = 1e-4**2
# Products of a task from which a step of k-means builds on the one before: half a second's.
_PRODUCTS_CARRIED = 4e9
# Steps of k-means after which every row is compared with all centres again.
_COMPARED_ANEW = 20


def nearest(x: np.ndarray, templates: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and squared distances of the k nearest templates of every row.

    Equal distances go by template position.
    """
    d2 = (x**2).sum(1)[:, None] + (templates**2).sum(1)[None, :] - 2 * x @ templates.T
    d2 = np.maximum(d2, 0.0)
    if k >= d2.shape[1]:
        order = np.argsort(d2, axis=1, kind="stable")
    else:
        order = np.argpartition(d2, k - 1, axis=1)[:, :k]
        edge = np.take_along_axis(d2, order, 1).max(1)
        tied = np.flatnonzero((d2 <= edge[:, None]).sum(1) > k)
        order[tied] = np.argsort(d2[tied], axis=1, kind="stable")[:, :k]
    return order[:, :k], np.take_along_axis(d2, order[:, :k], 1)


def _mean_of_nearest(
    templates: np.ndarray, labels: np.ndarray, k: int
) -> Callable[[Column | str], Column]:
    """A function from a vector column to the mean label vector of its k nearest templates."""

    @F.pandas_udf("array<double>")
    def predict(vecs: pd.Series) -> pd.Series:
        out = []
        step = max(1, _MATRIX_CELLS // max(1, len(templates)))
        for start in range(0, len(vecs), step):
            x = np.stack(vecs.iloc[start : start + step].to_numpy())
            out.extend(labels[nearest(x, templates, k)[0]].mean(axis=1))
        return pd.Series(out, index=vecs.index, dtype=object)

    return predict


def knn_join(
    queries: DataFrame,
    templates: DataFrame,
    k: int,
    query_id: str = "sample_id",
    vec: str = "vec",
    template_id: str = "template_id",
    label: str = "y",
    block_bytes: int = _BROADCAST_BYTES,
) -> DataFrame:
    """``(query_id, y_hat)``: mean label vector of the k nearest templates (Euclidean).

    Templates of a checked size are broadcast. More are cut by a hash into blocks that meet
    parts of the queries in the executors, and the neighbours of each block (k each) are
    merged per query. Queries without a vector get a null.
    """
    size = templates.agg(
        F.count("*").alias("n"), F.max(F.size(vec) + F.size(label)).alias("width")
    ).first()
    if not size.n:
        raise ValueError("no templates")
    n_blocks = -(-size.n * size.width * 8 // block_bytes)
    block_of = F.pmod(F.xxhash64(template_id), F.lit(n_blocks))
    if n_blocks == 1:
        rows = templates.select(template_id, vec, label).orderBy(template_id).collect()
        points, targets = (np.array([r[i] for r in rows], float) for i in (1, 2))
        predict = _mean_of_nearest(points, targets, min(k, len(points)))
        filled = vectors.or_zeros(vec, points.shape[1])
        return queries.select(
            query_id, vectors.blank_without(vec, predict(filled)).alias("y_hat")
        )
    id_type = dict(queries.dtypes)[query_id]
    label_id_type = dict(templates.dtypes)[template_id]
    neighbour = f"struct<d2:double,template:{label_id_type},label:array<double>>"
    known = queries.where(F.col(vec).isNotNull())
    n_parts = max(1, -(-known.count() // _QUERIES_PER_GROUP))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    # Each block of templates meets each part of the queries in a group of bounded size.
    blocks = templates.select(
        block_of.cast("int").alias("block"), number(n_parts).alias("part"), template_id, vec, label
    )
    asked = known.select(
        number(n_blocks).alias("block"),
        F.pmod(F.xxhash64(query_id), F.lit(n_parts)).cast("int").alias("part"),
        query_id,
        vec,
    )

    def search(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(block):
            return pd.DataFrame({query_id: asked[query_id].iloc[:0], "near": pd.Series([], dtype=object)})
        block = block.sort_values(template_id)
        names = block[template_id].to_list()
        points, labels = (np.stack(block[c].to_numpy()) for c in (vec, label))
        step = max(1, _MATRIX_CELLS // len(points))
        near = []
        for start in range(0, len(asked), step):
            x = np.stack(asked[vec].iloc[start : start + step].to_numpy())
            at, d2 = nearest(x, points, min(k, len(points)))
            near += [
                [{"d2": d, "template": names[j], "label": labels[j]} for j, d in zip(js, ds)]
                for js, ds in zip(at, d2)
            ]
        return pd.DataFrame({query_id: asked[query_id].to_numpy(), "near": pd.Series(near, dtype=object)})

    keys = ["block", "part"]
    found = (
        asked.groupBy(*keys)
        .cogroup(blocks.groupBy(*keys))
        .applyInPandas(search, f"`{query_id}` {id_type}, near array<{neighbour}>")
        .groupBy(query_id)
        .agg(F.flatten(F.collect_list("near")).alias("near"))
    )
    closest = F.slice(F.array_sort("near"), 1, k)
    width = F.size(F.element_at("near", 1)["label"])
    mean = F.transform(
        F.sequence(F.lit(1), width),
        lambda i: F.aggregate(
            "near", F.lit(0.0), lambda total, e: total + F.element_at(e.label, i)
        )
        / F.size("near"),
    )
    answered = found.withColumn("near", closest).select(query_id, mean.alias("y_hat"))
    without = queries.where(F.col(vec).isNull())
    return answered.unionByName(
        without.select(query_id, F.lit(None).cast("array<double>").alias("y_hat"))
    )


@dataclass
class CompressedKnnModel:
    """A fitted compressed kNN regressor."""

    reducer: PipelineModel
    templates: np.ndarray
    labels: np.ndarray
    n_neighbors: int
    n_items: int
    n_features: int
    variance_pca: float
    variance_kmeans: float
    explained: list[float]
    kmeans_converged: bool = True

    def predict_all(self, df: DataFrame, vec: str = "vec", out: str = "y_hat") -> DataFrame:
        """Add the predicted label vector, null for rows without a vector."""
        filled = vectors.or_zeros(vec, self.n_features)
        reduced = self.reducer.transform(df.withColumn("knn_in", array_to_vector(filled)))
        predict = _mean_of_nearest(self.templates, self.labels, self.n_neighbors)
        made = [*{"knn_in", "knn_centred", "knn_pca", "knn_z"} & set(reduced.columns)]
        y_hat = vectors.blank_without(vec, predict(vector_to_array("knn_z")))
        return reduced.withColumn(out, y_hat).drop(*made)

    def predict(self, df: DataFrame, vec: str = "vec", out: str = "p_knn") -> DataFrame:
        """Add the prediction of a single-column label."""
        return self.predict_all(df, vec, out).withColumn(out, F.element_at(out, 1))

    def pca_variance(self, df: DataFrame) -> DataFrame:
        """Explained variance ratio per component, and cumulated."""
        return explained_variance(df, self.explained)

    def report(self, df: DataFrame) -> DataFrame:
        """One row: sizes before and after, variance and numbers retained in percent, and
        whether k-means came to rest within its iterations."""
        k, c = self.templates.shape
        size = 100.0 * (k * c) / (self.n_items * self.n_features)
        retained = 100.0 * self.variance_pca * self.variance_kmeans
        return df.sparkSession.createDataFrame(
            [(self.n_items, self.n_features, k, c, retained, size, self.kmeans_converged)],
            "n_items long, n_features long, n_templates long, n_components long, "
            "variance_percent double, numbers_percent double, kmeans_converged boolean",
        )


def explained_variance(df: DataFrame, ratios: list[float]) -> DataFrame:
    """``(component, ratio, cumulative)`` from the ratios of a fitted PCA."""
    table = df.sparkSession.createDataFrame(
        [(i + 1, float(r)) for i, r in enumerate(ratios)], "component int, ratio double"
    )
    up_to = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return table.withColumn("cumulative", F.sum("ratio").over(up_to))


def template_aggregate(
    df: DataFrame, cluster: str, vec: str, label: str, n_clusters: int
) -> DataFrame:
    """``(template_id, vec, y)``: mean vector and mean label vector of every cluster.

    Clusters 0..n_clusters-1 without members are all zero.
    """
    width = df.select(F.size(vec).alias("v"), F.size(label).alias("y")).first()
    means = (
        df.groupBy(F.col(cluster).cast("long").alias("template_id"))
        .agg(
            vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)))).alias("vec"),
            vector_to_array(Summarizer.mean(array_to_vector(F.col(label)))).alias("y"),
        )
    )
    every = df.sparkSession.range(n_clusters).withColumnRenamed("id", "template_id")

    def or_zeros(name: str, n: int) -> Column:
        return F.coalesce(name, F.array_repeat(F.lit(0.0), n)).alias(name)

    joined = every.join(means, "template_id", "left")
    return joined.select("template_id", or_zeros("vec", width.v), or_zeros("y", width.y))


@dataclass
class Clustering:
    """Centres of a k-means, its steps and the cost seen by the last of them."""

    centres: np.ndarray
    steps: int
    cost: float

    def assign(self, df: DataFrame, vec: str, *keep: str) -> DataFrame:
        """Adds ``prediction``, the number of the nearest centre, to ``vec`` and ``keep``."""
        shared = df.sparkSession.sparkContext.broadcast(self.centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(vec).flatten().to_numpy().reshape(batch.num_rows, -1)
                    near = pa.array(_closest(x, shared.value), pa.int32())
                    yield pa.RecordBatch.from_arrays([*batch.columns, near], names=[*batch.schema.names, "prediction"])

        rows = df.select(vec, *keep)
        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("prediction", T.IntegerType())]))


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of every row, the lowest of equally near ones.

    Half the squared length of a centre is one more column of the product, which is written
    into the same few megabytes again and again.
    """
    weights = np.ascontiguousarray(np.c_[-centres, (centres**2).sum(1) / 2].T)
    rows = np.c_[x, np.ones(len(x))]
    out = np.empty(len(x), dtype=np.int64)
    step = max(1, _MATRIX_CELLS // (16 * len(centres)))
    held = np.empty((min(step, len(x)), len(centres)))
    for start in range(0, len(x), step):
        part = rows[start : start + step]
        near = np.matmul(part, weights, out=held[: len(part)])
        out[start : start + step] = near.argmin(axis=1)
    return out


def _two_closest(x: np.ndarray, centres: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """As ``_closest``, and a distance that no other centre of the row is within.

    ``slack`` bounds the rounding error of a squared distance.
    """
    weights = np.ascontiguousarray(np.c_[-centres, (centres**2).sum(1) / 2].T)
    rows = np.c_[x, np.ones(len(x))]
    near = np.empty(len(x), dtype=np.int64)
    others = np.empty(len(x))
    step = max(1, _MATRIX_CELLS // (16 * len(centres)))
    held = np.empty((min(step, len(x)), len(centres)))
    for start in range(0, len(x), step):
        part = rows[start : start + step]
        half = np.matmul(part, weights, out=held[: len(part)])
        at = half.argmin(axis=1)
        half[np.arange(len(part)), at] = np.inf
        near[start : start + step] = at
        others[start : start + step] = half.min(axis=1)
    return near, np.sqrt(np.maximum(2 * others + (x**2).sum(1) - slack, 0.0))


def _after_moves(
    x: np.ndarray, near: np.ndarray, beyond: np.ndarray, centres: np.ndarray, moves: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centres once the centres have moved, and the distance the others are beyond.

    ``near`` and ``beyond`` are those from before, ``moves`` how far each centre went. By the
    triangle inequality a centre that went less than ``rest`` is at most so much nearer. The
    few that went farther are compared with every row; a row that this does not settle is
    compared with all centres. How many count as far is chosen by the work that it leaves.
    """
    k, n = len(centres), len(x)
    length = (x**2).sum(1)
    slack = 1e-13 * (length.max() + (centres**2).sum(1).max())
    own = ((x - centres[near]) ** 2).sum(1)
    low, high = np.sqrt(np.maximum(own - slack, 0.0)), np.sqrt(own + slack)
    by_move = np.argsort(-moves, kind="stable")
    moved = np.count_nonzero(moves)
    least, far, rest = 1.2 * k * n, -1, 0.0
    for tried in (0, *(k >> i for i in range(8, 0, -1)), moved):
        if tried > moved:
            continue
        most = moves[by_move[tried]] if tried < k else 0.0
        work = tried * n + 1.2 * k * (n - np.count_nonzero(high < beyond - most))
        if work < least:
            least, far, rest = work, tried, most
    if far < 0:
        return _two_closest(x, centres, slack)
    near, beyond = near.copy(), beyond - rest - np.sqrt(slack) * 1e-3
    clear = np.ones(n, dtype=bool)
    if far:
        tested = np.sort(by_move[:far])
        place = np.full(k, -1)
        place[tested] = np.arange(far)
        weights = np.ascontiguousarray(np.c_[-centres[tested], (centres[tested] ** 2).sum(1) / 2].T)
        rows = np.c_[x, np.ones(n)]
        step = max(1, _MATRIX_CELLS // (16 * far))
        held = np.empty((min(step, n), far))
        for start in range(0, n, step):
            part = slice(start, start + step)
            half = np.matmul(rows[part], weights, out=held[: len(rows[part])])
            here = np.arange(len(half))
            of_own = place[near[part]]
            half[here[of_own >= 0], of_own[of_own >= 0]] = np.inf
            at = half.argmin(axis=1)
            best = 2 * half[here, at] + length[part]
            half[here, at] = np.inf
            second = 2 * half.min(axis=1) + length[part]
            best_low, best_high = np.sqrt(np.maximum(best - slack, 0.0)), np.sqrt(np.maximum(best, 0.0) + slack)
            stays, goes = high[part] < best_low, best_high < low[part]
            clear[part] = stays | goes
            second_low = np.sqrt(np.maximum(second - slack, 0.0))
            others = np.where(goes, np.minimum(low[part], second_low), best_low)
            beyond[part] = np.minimum(beyond[part], others)
            near[part] = np.where(goes, tested[at], near[part])
            high[part] = np.where(goes, best_high, high[part])
    open_rows = np.flatnonzero(~(clear & (high < beyond)))
    if len(open_rows):
        near[open_rows], beyond[open_rows] = _two_closest(x[open_rows], centres, slack)
    return near, beyond


def cluster(rows: DataFrame, vec: str, k: int, seed: int, max_iter: int) -> Clustering:
    """Lloyd's k-means over all rows of a vector column, from the start of Spark's k-means.

    Spark draws the first centres (k-means||). The steps are its own too, as are the rule for
    coming to rest and the cost, but tasks multiply whole blocks of rows with the centres in
    numpy. A step sends the centres out and ``k`` sums from each task back. Where a task has many
    products, it keeps the nearest centre of each row and how far the others are at least, so
    a step compares a row only with centres whose moves leave it open; every
    ``_COMPARED_ANEW`` steps all are compared, which also bounds what a lost block costs.
    """
    started = KMeans(k=k, seed=seed, featuresCol=vec, maxIter=0).fit(rows)
    centres = np.array(started.clusterCenters(), dtype=float)
    context = rows.sparkSession.sparkContext
    width = centres.shape[1]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.ascontiguousarray(batch.column("x").flatten().to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["x"])

    blocks = rows.select(vector_to_array(vec).alias("x")).mapInArrow(pack, "x binary").persist()
    n_parts = blocks.rdd.getNumPartitions()
    at_once = min(n_parts, context.defaultParallelism)
    steps, cost, n, moves = 0, 0.0, 0.0, np.full(k, np.inf)
    state, sent = None, []
    while steps < max_iter and (moves**2 > _AT_REST).any():
        shared = context.broadcast((centres, moves))

        def plainly(part: Iterator) -> Iterator[tuple]:
            for row in part:
                yield row["x"], _closest(np.frombuffer(row["x"]).reshape(-1, width), shared.value[0])

        def anew(part: Iterator) -> Iterator[tuple]:
            here, _ = shared.value
            top = (here**2).sum(1).max()
            for row in part:
                x = np.frombuffer(row["x"]).reshape(-1, width)
                yield row["x"], *_two_closest(x, here, 1e-13 * ((x**2).sum(1).max() + top))

        def onward(part: Iterator) -> Iterator[tuple]:
            for block, near, beyond in part:
                yield block, *_after_moves(np.frombuffer(block).reshape(-1, width), near, beyond, *shared.value)

        def sums(part: Iterator) -> Iterator[np.ndarray]:
            here, _ = shared.value
            out = np.zeros((len(here), width + 2))  # sums, rows and cost of every centre
            for block, near, *_ in part:
                x = np.frombuffer(block).reshape(-1, width)
                out[:, width] += np.bincount(near, minlength=len(here))
                out[:, width + 1] += np.bincount(near, ((x - here[near]) ** 2).sum(1), len(here))
                for c in range(width):
                    out[:, c] += np.bincount(near, x[:, c], len(here))
            yield out

        before, fresh = state, state is None or steps % _COMPARED_ANEW == 0
        # The first step counts the rows.
        if steps and n * k * width >= _PRODUCTS_CARRIED * at_once:
            state = blocks.rdd.mapPartitions(anew) if fresh else before.mapPartitions(onward)
            found = state.persist(StorageLevel.MEMORY_AND_DISK).mapPartitions(sums)
        else:
            found = blocks.rdd.mapPartitions(lambda part, nearest=plainly, add_up=sums: add_up(nearest(part)))
        total = found.reduce(add) if n_parts <= _SUMS_COLLECTED else found.treeReduce(add)
        if before is not None:
            before.unpersist()
        # A lost block is made again by the steps since its rows were compared with all centres.
        for old in sent if fresh else ():
            old.destroy()
        sent = [shared] if fresh else [*sent, shared]
        n = total[:, width].sum()
        used = total[:, width] > 0
        new = centres.copy()
        new[used] = total[used, :width] / total[used, width, None]
        moves = np.sqrt(((new - centres) ** 2).sum(1))
        centres, cost, steps = new, float(total[:, width + 1].sum()), steps + 1
    if state is not None:
        state.unpersist()
    for old in sent:
        old.destroy()
    blocks.unpersist()
    return Clustering(centres, steps, cost)


def fit_knn(
    df: DataFrame, params: KnnParams, vec: str = "vec", label: str = "label"
) -> CompressedKnnModel:
    """Fit on vectors and a numeric or array label; every step is a Spark job.

    PCA is fitted on centred data because Spark's PCA does not centre when it transforms.
    Rows without a vector or a label are left out.
    """
    y = F.col(label)
    if df.schema[label].dataType.typeName() != "array":
        y = F.array(y.cast("double"))
    usable = vectors.with_vector(df, vec, label)
    data = usable.select(array_to_vector(vec).alias("knn_in"), y.alias("y")).persist()
    size = data.agg(F.count("*").alias("n"), F.max(F.size(vector_to_array("knn_in")))).first()
    n, width = size[0], size[1]
    n_components = max(1, min(params.n_cols, int(0.9 * width), int(0.9 * n)))

    centre = StandardScaler(
        withMean=True, withStd=False, inputCol="knn_in", outputCol="knn_centred"
    ).fit(data)
    centred = centre.transform(data)
    pca = PCA(
        k=n_components,
        inputCol="knn_centred",
        outputCol="knn_pca" if params.whiten else "knn_z",
    ).fit(centred)
    stages = [centre, pca]
    reduced = pca.transform(centred)
    if params.whiten:
        # Division by the standard deviation of every component.
        whiten = StandardScaler(
            withMean=False, withStd=True, inputCol="knn_pca", outputCol="knn_z"
        ).fit(reduced)
        stages.append(whiten)
        reduced = whiten.transform(reduced)
    reduced = reduced.select("knn_z", "y").persist()

    n_clusters = max(
        1, min(params.n_rows, int(0.8 * params.minibatch_size_kmeans), int(0.8 * n))
    )
    work = float(n) * n_clusters * n_components
    clusters = cluster(
        packed(reduced, work, _PRODUCTS_PER_TASK), "knn_z", n_clusters, params.seed, params.kmeans_iterations
    )
    spread = reduced.agg(Summarizer.variance(F.col("knn_z"))).first()[0].toArray().sum() * (n - 1)
    inertia = clusters.cost

    members = clusters.assign(reduced.select(vector_to_array("knn_z").alias("vec"), "y"), "vec", "y")
    # n_clusters rows of n_components numbers: both are parameters.
    rows = (
        template_aggregate(members, "prediction", "vec", "y", n_clusters)
        .orderBy("template_id")
        .collect()
    )
    reduced.unpersist()
    data.unpersist()
    return CompressedKnnModel(
        reducer=PipelineModel(stages),
        templates=np.array([r.vec for r in rows], float),
        labels=np.array([r.y for r in rows], float),
        n_neighbors=min(params.n_neighbors, params.n_rows, n, n_clusters),
        n_items=n,
        n_features=width,
        variance_pca=float(pca.explainedVariance.toArray().sum()),
        variance_kmeans=float(1 - inertia / spread) if spread > 0 else 1.0,
        explained=[float(r) for r in pca.explainedVariance.toArray()],
        kmeans_converged=clusters.steps < params.kmeans_iterations,
    )
