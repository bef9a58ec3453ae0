"""Cross-validation of the ensemble."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.vectors import with_vector
from gleaner.operators import metrics
from gleaner.operators.ensemble import MEMBERS, EnsembleModel, fit_ensembles, weighted_score
from gleaner.operators.folds import stratified_folds
from gleaner.operators.params import EnsembleParams
from gleaner.session import staged

CLASSIFIERS = {"kNN": "p_knn", "LR": "p_lr", "GBT": "p_gbt", "ensemble": "p_ensemble"}


def fold_metrics(scores: DataFrame) -> DataFrame:
    """Accuracy, RMSE, AUC and rows per repeat, fold, subset and classifier."""
    stacked = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("classifier"), F.col(p).alias("p"))
                for name, p in CLASSIFIERS.items()
            ]
        )
    )
    by = ["repeat", "fold", "subset", "classifier"]
    long = scores.select("repeat", "fold", "subset", "label", stacked.alias("c")).select(
        "repeat", "fold", "subset", "label", "c.classifier", "c.p"
    )
    return metrics.evaluate(long, "p", "label", by)


@dataclass
class Validation:
    """Out-of-fold scores, fold metrics and, if asked for, the fit on all rows."""

    oof: DataFrame
    fold_metrics: DataFrame
    final: EnsembleModel | None = None


def cross_validate(
    df: DataFrame,
    params: EnsembleParams,
    id_col: str = "sample_id",
    vec: str = "vec",
    label: str = "label",
    n_splits: int = 5,
    n_repeats: int = 1,
    seed: int = 123,
    with_final: bool = False,
) -> Validation:
    """Out-of-fold scores of every labeled item, and metrics of every fold.

    Each fold fits all three members on the other folds, with the parameters of the whole
    set's size, and scores both parts; items without a vector keep null scores. The fits of
    all folds, and the final one on all rows if wanted, run together; all scores are written
    once and evaluated together.
    """
    labeled = df.select(id_col, F.col(label).alias("label"), F.col(vec).alias("vec"))
    drawn = stratified_folds(labeled, id_col, "label", n_splits, n_repeats, seed)
    # Fold f of repeat r is fit number r * n_splits + f, the final fit comes after all.
    of_repeat = F.transform(
        F.sequence(F.lit(0), F.lit(n_splits - 1)), lambda f: F.when(f != F.col("fold"), F.col("repeat") * n_splits + f)
    )
    last = n_repeats * n_splits
    also = F.when(F.col("repeat") == 0, F.array(F.lit(last))).otherwise(F.array().cast("array<int>"))
    fits = F.concat(F.array_compact(of_repeat), also) if with_final else F.array_compact(of_repeat)
    drawn = staged(drawn.withColumn("fits", fits), "folds")
    n = with_vector(labeled, "vec", "label").count()
    models = fit_ensembles(drawn, params, last + with_final, "fits", n_for_rule=n)

    def scored(number: int) -> DataFrame:
        repeat, fold = divmod(number, n_splits)
        model = models[number]
        rows = drawn.where(F.col("repeat") == repeat)
        subset = F.when(F.col("fold") == fold, F.lit("valid")).otherwise(F.lit("train"))
        ensemble = weighted_score(model.params.weights)
        return model.predict(rows.withColumn("subset", subset)).select(
            id_col, F.lit(repeat).alias("repeat"), F.lit(fold).alias("fold"), "subset",
            "label", *MEMBERS, ensemble.alias("p_ensemble"),
        )

    scores = scored(0)
    for number in range(1, last):
        scores = scores.unionByName(scored(number))
    scores = staged(scores, "fold_scores")
    oof = scores.where("subset = 'valid'").drop("subset")
    return Validation(oof, fold_metrics(scores), models[last] if with_final else None)
