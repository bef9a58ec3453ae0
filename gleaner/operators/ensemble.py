"""The three-model ensemble: compressed kNN, logistic regression, boosted trees."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.vectors import with_vector
from gleaner.operators.collect import checked_width
from gleaner.operators.knn import CompressedKnnModel, fit_knn
from gleaner.operators.linear import LogisticModel, fit_logistic
from gleaner.operators.params import EnsembleParams, for_sample_size
from gleaner.operators.trees import TreesModel, fit_many

MEMBERS = ("p_knn", "p_lr", "p_gbt")


def weighted_score(weights: Sequence[float], columns: Sequence[str] = MEMBERS) -> Column:
    """Weighted mean of score columns; the weights are normalised to sum 1."""
    if len(weights) != len(columns):
        raise ValueError(f"{len(weights)} weights for {len(columns)} scores")
    total = 0.0
    for w in weights:
        total += w
    terms = [F.lit(w / total) * F.col(c) for w, c in zip(weights, columns)]
    mixed = terms[0]
    for term in terms[1:]:
        mixed = mixed + term
    return mixed


@dataclass
class EnsembleModel:
    """A fitted ensemble. ``best`` holds the validated weights and margins, if any."""

    params: EnsembleParams
    knn: CompressedKnnModel
    logistic: LogisticModel
    trees: TreesModel
    n_features: int
    models_for_features: tuple[str, ...] = ()
    n_positive: int | None = None
    n_negative: int | None = None
    best: dict | None = None

    def predict(
        self, df: DataFrame, vec: str = "vec", weights: Sequence[float] | None = None
    ) -> DataFrame:
        """Add the member scores and the ensemble score ``p``.

        A vector of another width than at fit time fails the job. Rows without a vector
        keep null scores.
        """
        # Missing vectors are scored as zeros and blanked afterwards: one pass over df.
        zeros = F.array_repeat(F.lit(0.0), self.n_features)
        usable = df.withColumn(
            "model_in", F.coalesce(checked_width(vec, self.n_features), zeros)
        )
        for member in (self.knn, self.logistic, self.trees):
            usable = member.predict(usable, "model_in")
        for name in MEMBERS:
            usable = usable.withColumn(name, F.when(F.col(vec).isNotNull(), F.col(name)))
        return usable.drop("model_in").withColumn(
            "p", weighted_score(weights or self.params.weights)
        )

    def with_weights(self, weights: Sequence[float]) -> EnsembleModel:
        """The same ensemble with other weights."""
        return replace(self, params=replace(self.params, weights=tuple(weights)))


def fit_ensembles(
    df: DataFrame,
    params: EnsembleParams,
    n_fits: int,
    fits: str = "fits",
    vec: str = "vec",
    label: str = "label",
    n_for_rule: int | None = None,
    parallel_fits: int = 6,
) -> list[EnsembleModel]:
    """Several ensembles: number ``i`` learns from the rows whose array ``fits`` has ``i``.

    The boosted trees of all fits advance in one job, the other members are fitted side by
    side. Rows without a vector or a label are left out. The small-sample rule sees
    ``n_for_rule`` rows (cross-validation passes the size of the whole set), by default all
    rows that are left.
    """
    df = with_vector(df, vec, label)
    n = n_for_rule if n_for_rule is not None else df.count()
    effective = for_sample_size(params, n)

    def members(i: int) -> tuple[CompressedKnnModel, LogisticModel]:
        rows = df.where(F.array_contains(fits, i))
        return fit_knn(rows, effective.knn, vec, label), fit_logistic(rows, effective.logistic, vec, label)

    threads = inheritable_thread_target(df.sparkSession)
    with ThreadPool(min(parallel_fits, n_fits) + 1) as pool:
        boosted = pool.apply_async(threads(fit_many), (df, effective, n_fits, fits, vec, label))
        others = pool.map(threads(members), range(n_fits))
        trees = boosted.get()
    return [
        EnsembleModel(params=effective, knn=knn, logistic=logistic, trees=t, n_features=knn.n_features)
        for (knn, logistic), t in zip(others, trees, strict=True)
    ]


def fit_ensemble(
    df: DataFrame,
    params: EnsembleParams,
    vec: str = "vec",
    label: str = "label",
    n_for_rule: int | None = None,
) -> EnsembleModel:
    """Fit the three members on ``vec`` and a 0/1 label; see ``fit_ensembles``."""
    alone = df.withColumn("fits", F.array(F.lit(0)))
    return fit_ensembles(alone, params, 1, "fits", vec, label, n_for_rule)[0]
