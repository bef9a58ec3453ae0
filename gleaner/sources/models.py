"""Saving and loading a fitted ensemble as a folder of Spark ML models and Parquet."""

from __future__ import annotations

import datetime
import json

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import trees
from gleaner.operators.ensemble import EnsembleModel
from gleaner.operators.knn import CompressedKnnModel
from gleaner.operators.linear import LogisticModel
from gleaner.operators.params import EnsembleParams

MODEL_PREFIX = "good_vs_bad_classifier"


def model_name(
    prefix: str,
    n_samples: int | None,
    n_features: int | None,
    date: datetime.date | None = None,
) -> str:
    """Name of a saved model; without counts only the prefix and the date."""
    day = (date or datetime.date.today()).strftime("%Y-%m-%d")
    if n_samples is None or n_features is None:
        return f"{prefix}_{day}"
    return f"{prefix}_num_samples_{n_samples}_num_features_{n_features}_{day}"


def save_model(
    spark: SparkSession, model: EnsembleModel, folder: str, prefix: str = MODEL_PREFIX
) -> str:
    """Write the ensemble below ``folder`` and return its path."""
    known = model.n_positive is not None and model.n_negative is not None
    n_samples = model.n_positive + model.n_negative if known else None
    path = f"{folder.rstrip('/')}/{model_name(prefix, n_samples, model.n_features)}"
    model.knn.reducer.write().overwrite().save(f"{path}/reducer")
    model.logistic.model.write().overwrite().save(f"{path}/logistic")
    model.trees.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
    rows = [
        (i, [float(x) for x in vec], [float(x) for x in y])
        for i, (vec, y) in enumerate(zip(model.knn.templates, model.knn.labels))
    ]
    spark.createDataFrame(
        rows, "template_id long, vec array<double>, y array<double>"
    ).write.mode("overwrite").parquet(f"{path}/templates")
    facts = {
        "params": json.loads(model.params.to_json()),
        "n_features": model.n_features,
        "models_for_features": list(model.models_for_features),
        "n_positive": model.n_positive,
        "n_negative": model.n_negative,
        "best": model.best,
        "knn": {
            "n_neighbors": model.knn.n_neighbors,
            "n_items": model.knn.n_items,
            "n_features": model.knn.n_features,
            "variance_pca": model.knn.variance_pca,
            "variance_kmeans": model.knn.variance_kmeans,
            "explained": model.knn.explained,
            "kmeans_converged": bool(model.knn.kmeans_converged),
        },
        "logistic_converged": bool(model.logistic.converged),
    }
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/params")
    return path


def load_model(spark: SparkSession, path: str) -> EnsembleModel:
    """Restore an ensemble written by ``save_model``."""
    path = path.rstrip("/")
    facts = json.loads(spark.read.text(f"{path}/params", wholetext=True).first().value)
    rows = spark.read.parquet(f"{path}/templates").orderBy("template_id").collect()
    knn = CompressedKnnModel(
        reducer=PipelineModel.load(f"{path}/reducer"),
        templates=np.array([r.vec for r in rows], float),
        labels=np.array([r.y for r in rows], float),
        **facts["knn"],
    )
    return EnsembleModel(
        params=EnsembleParams.from_json(json.dumps(facts["params"])),
        knn=knn,
        logistic=LogisticModel(
            LogisticRegressionModel.load(f"{path}/logistic"), facts["logistic_converged"]
        ),
        trees=trees.from_rows(spark.read.parquet(f"{path}/trees").collect(), facts["n_features"]),
        n_features=facts["n_features"],
        models_for_features=tuple(facts["models_for_features"]),
        n_positive=facts["n_positive"],
        n_negative=facts["n_negative"],
        best=facts["best"],
    )


def model_name_column(prefix: str, n_samples: Column, n_features: Column, day: Column) -> Column:
    """``model_name`` as a column expression, for counts that come from a table."""
    return F.format_string(
        f"{prefix}_num_samples_%d_num_features_%d_%s",
        n_samples,
        n_features,
        F.date_format(day, "yyyy-MM-dd"),
    )
