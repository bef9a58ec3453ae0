"""Quality scores by regularised quadratic discriminant analysis of document statistics.

Each class is a Gaussian over transformed statistics of the text. Its covariance is shrunk
towards the covariance within both classes and towards a multiple of the identity. The score
is the logistic function of the difference of both log densities (Mahalanobis distances by
the cached Cholesky factors) plus the log ratio of the class shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import words

#: Classes of bytes: other, lower a-z, upper A-Z, digit, sentence mark, bracket or quote,
#: any other ASCII mark, blank, line end, part of a longer character.
_CLASSES = 10
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 6
_CLASS[[ord(c) for c in ".,;:?"]] = 4
_CLASS[[ord(c) for c in "()[]\"'-"]] = 5
_CLASS[[0x20, 0x09]] = 7
_CLASS[[0x0A, 0x0D]] = 8
_CLASS[0x80:] = 9

FEATURES = (
    "log_words",
    "word_length",
    "upper",
    "digits",
    "sentence_marks",
    "brackets",
    "other_marks",
    "line_ends",
    "long_characters",
    "capitalised",
    "bare_words",
    "marked_words",
    "repeats",
    "variety",
)


@dataclass(frozen=True)
class QdaParams:
    """``pooled`` and ``ridge`` are the shares of the two shrinkage targets."""

    pooled: float = 0.1
    ridge: float = 0.02


@dataclass(frozen=True)
class QdaModel:
    """Means, inverse Cholesky factors, half log determinants and log shares by class."""

    means: np.ndarray
    whiten: np.ndarray
    half_log_det: np.ndarray
    log_share: np.ndarray
    only: float | None = None


def _share(part: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Log odds of a share, smoothed so that an empty text has a finite value."""
    return np.log((part + 0.5) / (np.maximum(of - part, 0) + 0.5))


def statistics(column: pa.Array) -> np.ndarray:
    """The transformed statistics of every text, one row each; null counts as empty."""
    n = len(column)
    data, offsets = words.utf8(column)
    text = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(text * _CLASSES + _CLASS[data], minlength=n * _CLASSES)
    counts = counts.reshape(n, _CLASSES).astype(float)
    w = words.split(column, lower=False)
    n_words = w.counts().astype(float)
    sums = lambda flags: np.bincount(w.text, weights=flags.astype(float), minlength=n)
    first, last = _CLASS[w.data[w.start]], _CLASS[w.data[w.end - 1]]
    letter = np.isin(_CLASS[w.data], (1, 2, 9))
    letters_before = np.concatenate([[0], np.cumsum(letter)])
    bare = letters_before[w.end] == letters_before[w.start]
    h = w.hashes()
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (w.text[1:] == w.text[:-1])
    firsts = w.firsts()
    distinct = np.array(
        [len(np.unique(h[a:b])) for a, b in zip(firsts[:-1], firsts[1:], strict=True)], dtype=float
    )
    size = np.diff(offsets).astype(float)
    letters = counts[:, 1] + counts[:, 2] + counts[:, 9]
    columns = [
        np.log1p(n_words),
        np.log1p(size / (n_words + 1)),
        _share(counts[:, 2], letters),
        _share(counts[:, 3], size),
        _share(counts[:, 4], size),
        _share(counts[:, 5], size),
        _share(counts[:, 6], size),
        _share(counts[:, 8], size),
        _share(counts[:, 9], size),
        _share(sums(first == 2), n_words),
        _share(sums(bare), n_words),
        _share(sums(last == 6), n_words),
        _share(sums(again), n_words),
        np.log1p(distinct) - 0.8 * np.log1p(n_words),
    ]
    return np.column_stack(columns)


def described(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the array column ``statistics`` in place of the text."""

    def compute(column: pa.Array) -> list:
        values = statistics(column)
        return [words.lists(values.reshape(-1), np.full(len(values), len(FEATURES)), pa.float64())]

    return words.with_columns(
        docs, text, {"statistics": "array<double>"}, compute, keep=[c for c in docs.columns if c not in (text, "statistics")]
    )


def fit(labeled: DataFrame, params: QdaParams | None = None) -> QdaModel:
    """Fit on (statistics, label) with labels 0 and 1; other labels and nulls are left out.

    Tasks send moment sums per class, which are added up by matrix entry: the driver gets a
    fixed number of rows.
    """
    params = params or QdaParams()
    k = len(FEATURES)
    schema = pa.schema([("label", pa.int32()), ("entry", pa.int32()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments = np.zeros((2, (k + 1) * (k + 1)))
        for batch in batches:
            values = batch.column("statistics").flatten().to_numpy().reshape(-1, k)
            values = np.column_stack([np.ones(len(values)), values])
            label = batch.column("label").to_numpy()
            for c in (0, 1):
                own = values[label == c]
                moments[c] += (own.T @ own).reshape(-1)
        for c in (0, 1):
            yield words.record(schema, np.full(moments.shape[1], c), np.arange(moments.shape[1]), moments[c])

    known = labeled.select("statistics", F.col("label").cast("int")).where(F.col("label").isin(0, 1))
    summed = (
        known.mapInArrow(run, "label int, entry int, value double")
        .groupBy("label", "entry")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    moments = np.zeros((2, k + 1, k + 1))
    for row in summed:
        moments[row["label"], row["entry"] // (k + 1), row["entry"] % (k + 1)] = row["value"]
    n = moments[:, 0, 0]
    if not n.all():
        only = 0.5 if not n.any() else float(n[1] > 0)
        return QdaModel(np.zeros((2, k)), np.zeros((2, k, k)), np.zeros(2), np.zeros(2), only)
    means = moments[:, 0, 1:] / n[:, None]
    scatter = moments[:, 1:, 1:] - n[:, None, None] * np.einsum("ci,cj->cij", means, means)
    pooled = scatter.sum(axis=0) / n.sum()
    scale = np.trace(pooled) / k + 1e-9
    whiten, half = np.empty((2, k, k)), np.empty(2)
    for c in (0, 1):
        own = (1 - params.pooled) * scatter[c] / n[c] + params.pooled * pooled
        own = (1 - params.ridge) * own + params.ridge * scale * np.eye(k)
        factor = np.linalg.cholesky(own)
        whiten[c] = np.linalg.inv(factor)
        half[c] = np.log(np.diag(factor)).sum()
    return QdaModel(means, whiten, half, np.log(n / n.sum()))


def scores(model: QdaModel, values: np.ndarray) -> np.ndarray:
    """The probability of label 1 for each row of statistics."""
    if model.only is not None:
        return np.full(len(values), model.only)
    log_density = np.empty((2, len(values)))
    for c in (0, 1):
        white = (values - model.means[c]) @ model.whiten[c].T
        log_density[c] = model.log_share[c] - model.half_log_det[c] - 0.5 * (white**2).sum(axis=1)
    gap = np.clip(log_density[1] - log_density[0], -500, 500)
    return 1 / (1 + np.exp(-gap))


def predict(rows: DataFrame, model: QdaModel) -> DataFrame:
    """Replaces ``statistics`` by ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    With labels of one class only the score is that class everywhere, without any it is 0.5.
    An empty text has statistics like any other. Columns named ``score`` or ``predicted`` are
    replaced.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("statistics").flatten().to_numpy().reshape(-1, len(FEATURES))
            score = scores(shared.value, values)
            kept = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "statistics"]
            names = [name for name in batch.schema.names if name != "statistics"]
            predicted = pa.array((score >= 0.5).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*kept, pa.array(score), predicted], names=[*names, "score", "predicted"])

    clean = rows.drop("score", "predicted")
    schema = clean.drop("statistics").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    return clean.mapInArrow(run, schema)
