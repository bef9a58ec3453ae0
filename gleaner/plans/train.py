"""Training jobs: fit from labeled sets, score a pool, retrain during labeling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.vectors import with_vector
from gleaner.operators import dedup, ensemble_weights, validate
from gleaner.operators.collect import check_same_models
from gleaner.operators.ensemble import EnsembleModel, fit_ensemble
from gleaner.operators.params import CROSS_VALIDATION_ABOVE, EnsembleParams
from gleaner.sources.models import MODEL_PREFIX, save_model
from gleaner.sources.store import labeled_set


@dataclass
class Training:
    """A fitted model with its out-of-fold scores and fold metrics (None if not run).

    ``n_without_vector`` counts labeled items that no fit could use; ``path`` is where the
    model was saved.
    """

    model: EnsembleModel
    oof: DataFrame | None
    fold_metrics: DataFrame | None
    n_without_vector: int = 0
    path: str | None = None


def fit_from_sets(
    positive: DataFrame,
    negative: DataFrame,
    params: EnsembleParams,
    models_for_features: Sequence[str] = (),
    remove_duplicates: bool = False,
    duplicates_vec: str = "vec",
    n_duplicate_models: int | None = None,
    similarity_threshold: float = 0.99,
    perform_cross_validation: bool = False,
    reset_weights: bool = False,
    n_weights: int = ensemble_weights.N_TRIPLES,
) -> Training:
    """Fit the ensemble on ``(sample_id, vec)`` sets of both classes.

    Optionally drops near duplicates inside each class first, by a column of as many unit
    blocks as ``n_duplicate_models`` (by default the models of the features).
    Cross-validation and the weight search run only for more than 80 labeled items.
    """
    if remove_duplicates:
        n_duplicate_models = n_duplicate_models or max(1, len(models_for_features))
        search = dict(
            vec=duplicates_vec, threshold=similarity_threshold, n_models=n_duplicate_models
        )
        positive = dedup.drop_near_duplicates(positive, **search)
        negative = dedup.drop_near_duplicates(negative, **search)
    return fit_labeled(
        labeled_set(positive, negative),
        params,
        models_for_features,
        perform_cross_validation,
        reset_weights,
        n_weights,
    )


def fit_labeled(
    labeled: DataFrame,
    params: EnsembleParams,
    models_for_features: Sequence[str] = (),
    perform_cross_validation: bool = False,
    reset_weights: bool = False,
    n_weights: int = ensemble_weights.N_TRIPLES,
) -> Training:
    """Fit on ``(sample_id, vec, label)``; see ``fit_from_sets``."""
    labeled = labeled.select("sample_id", "vec", "label").persist()
    without = labeled.where("vec is null and label is not null").count()
    counts = with_vector(labeled, "vec", "label").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    ).first()
    n = counts.pos + counts.neg
    oof = folds = best = None
    if perform_cross_validation and n > CROSS_VALIDATION_ABOVE:
        validated = validate.cross_validate(labeled, params, with_final=True)
        fitted, oof, folds = validated.final, validated.oof, validated.fold_metrics
        searched = ensemble_weights.weight_search(oof, n=n_weights)
        best = ensemble_weights.best_weights(searched).first().asDict()
    else:
        fitted = fit_ensemble(labeled, params)
    model = replace(
        fitted,
        models_for_features=tuple(models_for_features),
        n_positive=counts.pos,
        n_negative=counts.neg,
        best=best,
    )
    if best and reset_weights:
        model = model.with_weights([best[w] for w in ensemble_weights.WEIGHTS])
    labeled.unpersist()
    return Training(model, oof, folds, without)


def score_items(
    model: EnsembleModel, items: DataFrame, weights: Sequence[float] | None = None
) -> DataFrame:
    """``(sample_id, p_knn, p_lr, p_gbt, p)`` of every item."""
    scored = model.predict(items, weights=weights)
    return scored.select("sample_id", "p_knn", "p_lr", "p_gbt", "p")


def keep_best_copies(
    model: EnsembleModel, items: DataFrame, models: Sequence[str], threshold: float = 0.99
) -> DataFrame:
    """Drop near duplicates, keeping the copy the model scores highest."""
    check_same_models(model.models_for_features, models)
    scored = model.predict(items).select(
        "sample_id", "vec", F.coalesce("p", F.lit(0.0)).alias("p")
    )
    kept = dedup.survivors(scored, order=["p"], threshold=threshold, n_models=len(models))
    return items.join(kept, "sample_id", "left_semi")


def retrain_and_rescore(
    labeled: DataFrame,
    pool: DataFrame,
    params: EnsembleParams,
    models_folder: str | None = None,
    prefix: str = MODEL_PREFIX,
    n_weights: int = ensemble_weights.N_TRIPLES,
    models_for_features: Sequence[str] = (),
    remove_duplicates: bool = False,
    duplicates_vec: str = "vec",
    n_duplicate_models: int | None = None,
    similarity_threshold: float = 0.99,
) -> tuple[Training, DataFrame]:
    """Refit with cross-validation, adopt the best weights, rescore the pool, save.

    The saved model carries ``models_for_features``; near duplicates inside each class go
    first if asked for. The session starts afresh: callers keep no label flags or session
    scores after this.
    """
    columns = list(dict.fromkeys(["sample_id", "vec", duplicates_vec]))
    training = fit_from_sets(
        labeled.where("label = 1").select(*columns),
        labeled.where("label = 0").select(*columns),
        params,
        models_for_features,
        remove_duplicates,
        duplicates_vec,
        n_duplicate_models,
        similarity_threshold,
        perform_cross_validation=True,
        reset_weights=True,
        n_weights=n_weights,
    )
    if models_folder:
        training.path = save_model(pool.sparkSession, training.model, models_folder, prefix)
    return training, score_items(training.model, pool)
