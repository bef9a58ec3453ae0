"""Parameters of the ensemble and the rule that adapts them to few labels."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace


# Fixed values in this file: the defaults, the training preset and the limits and numbers
# of the small-sample rule.
@dataclass(frozen=True)
class KnnParams:
    n_cols: int = 120
    n_rows: int = 4000
    n_neighbors: int = 13
    whiten: bool = False
    minibatch_size_kmeans: int = 5000
    seed: int = 1
    # Most k-means iterations; fits report whether they came to rest before.
    kmeans_iterations: int = 100


@dataclass(frozen=True)
class LogisticParams:
    c: float = 1.0
    class_weight: tuple[float, float] = (0.5, 0.5)
    # Most optimiser steps; fits report whether they converged before.
    max_iter: int = 100


@dataclass(frozen=True)
class TreeParams:
    num_trees: int = 3000
    num_leaves: int = 8
    min_data_in_leaf: int = 200
    learning_rate: float = 0.01
    column_sample: float = 0.25
    row_sample: float = 0.35
    seed: int = 1


@dataclass(frozen=True)
class EnsembleParams:
    knn: KnnParams = field(default_factory=KnnParams)
    logistic: LogisticParams = field(default_factory=LogisticParams)
    trees: TreeParams = field(default_factory=TreeParams)
    weights: tuple[float, float, float] = (0.3, 0.4, 0.3)
    # (number of trees, learning rate) to use instead of those of ``trees``.
    boosting: tuple[int, float] | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> EnsembleParams:
        raw = json.loads(text)
        raw["logistic"]["class_weight"] = tuple(raw["logistic"]["class_weight"])
        return EnsembleParams(
            knn=KnnParams(**raw["knn"]),
            logistic=LogisticParams(**raw["logistic"]),
            trees=TreeParams(**raw["trees"]),
            weights=tuple(raw["weights"]),
            boosting=tuple(raw["boosting"]) if raw["boosting"] else None,
        )


DEFAULT = EnsembleParams()
# The preset of the training job differs from the defaults in C only.
TRAINING = EnsembleParams(logistic=LogisticParams(c=0.75))

SMALL_SAMPLE_BELOW = 800
CROSS_VALIDATION_ABOVE = 80


def for_sample_size(params: EnsembleParams, n: int) -> EnsembleParams:
    """Effective parameters for ``n`` labeled items; the input is not changed."""
    if n >= SMALL_SAMPLE_BELOW:
        return params
    return replace(
        params,
        knn=replace(
            params.knn,
            n_cols=min(int(0.7 * n), 80),
            n_rows=min(int(0.6 * n), 500),
            n_neighbors=9,
        ),
        logistic=replace(params.logistic, c=0.1),
        trees=replace(
            params.trees,
            num_trees=750,
            min_data_in_leaf=min(int(0.25 * n), 100),
            row_sample=0.6,
        ),
    )


def boosting_rounds(params: EnsembleParams) -> tuple[int, float]:
    """Number of trees and learning rate in effect."""
    return params.boosting or (params.trees.num_trees, params.trees.learning_rate)
