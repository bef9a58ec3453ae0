"""Logistic regression and linear discriminant analysis."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import vectors
from gleaner.operators.params import LogisticParams
from gleaner.session import packed

# Vector elements a task of one optimiser step should hold.
_NUMBERS_PER_TASK = 2e6


@dataclass
class LogisticModel:
    """A fitted regression; ``converged`` tells whether it needed fewer steps than allowed."""

    model: LogisticRegressionModel
    converged: bool = True

    def predict(self, df: DataFrame, vec: str = "vec", out: str = "p_lr") -> DataFrame:
        """Add the probability of class 1, null for rows without a vector."""
        filled = vectors.or_zeros(vec, self.model.numFeatures)
        scored = self.model.transform(df.withColumn("lr_in", array_to_vector(filled)))
        p = F.element_at(vector_to_array("lr_prob"), 2)
        return scored.withColumn(out, vectors.blank_without(vec, p)).drop(
            "lr_in", "lr_raw", "lr_prob", "lr_class"
        )


def fit_logistic(
    df: DataFrame,
    params: LogisticParams,
    vec: str = "vec",
    label: str = "label",
    max_iter: int | None = None,
) -> LogisticModel:
    """L2 logistic regression with strength ``c``: ``|w|^2 / 2 + c * sum(weight * loss)``.

    Spark divides the loss by the sum of weights, hence ``regParam = 1 / (c * sum)``; the
    intercept is not penalised and features are not rescaled. Rows without a vector or a
    label are left out. ``max_iter`` replaces that of the parameters.
    """
    max_iter = max_iter or params.max_iter
    negative, positive = params.class_weight
    weight = F.when(F.col(label) == 1, F.lit(positive)).otherwise(F.lit(negative))
    data = vectors.with_vector(df, vec, label).select(
        array_to_vector(vec).alias("lr_in"),
        F.col(label).cast("double").alias("label"),
        weight.alias("weight"),
    ).persist()
    size = data.agg(
        F.sum("weight").alias("weight"),
        F.count("*").alias("n"),
        F.max(F.size(vector_to_array("lr_in"))).alias("width"),
    ).first()
    model = LogisticRegression(
        featuresCol="lr_in",
        labelCol="label",
        weightCol="weight",
        probabilityCol="lr_prob",
        rawPredictionCol="lr_raw",
        predictionCol="lr_class",
        regParam=1.0 / (params.c * size.weight),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=1e-8,
    ).fit(packed(data, size.n * size.width, _NUMBERS_PER_TASK))
    data.unpersist()
    return LogisticModel(model, model.summary.totalIterations < max_iter)


@dataclass
class DiscriminantModel:
    coefficients: np.ndarray
    intercept: float

    def predict(self, df: DataFrame, vec: str = "vec", out: str = "p_lda") -> DataFrame:
        """Add the probability of class 1, null for rows without a vector."""
        coefficients, intercept = self.coefficients, self.intercept

        @F.pandas_udf("double")
        def linear(vecs: pd.Series) -> pd.Series:
            return pd.Series(np.stack(vecs.to_numpy()) @ coefficients + intercept)

        p = 1 / (1 + F.exp(-linear(vectors.or_zeros(vec, len(coefficients)))))
        return df.withColumn(out, vectors.blank_without(vec, p))


def fit_discriminant(
    df: DataFrame,
    vec: str = "vec",
    label: str = "label",
    priors: tuple[float, float] = (0.5, 0.5),
) -> DiscriminantModel:
    """Linear discriminant of two classes with given priors.

    The pooled within-class scatter is the total scatter minus the part between the class
    means. The total scatter comes from Spark's PCA with all components (a distributed
    Gram matrix); only matrices of the feature width reach the driver. Rows without a vector
    or a label are left out.
    """
    data = vectors.with_vector(df, vec, label).select(
        array_to_vector(vec).alias("x"), F.col(label).cast("int").alias("y")
    ).persist()
    per_class = {
        r.y: (r.n, r.mean.toArray())
        for r in data.groupBy("y")
        .agg(F.count("*").alias("n"), Summarizer.mean(F.col("x")).alias("mean"))
        .collect()
    }
    if set(per_class) != {0, 1}:
        raise ValueError("a discriminant needs both classes, 0 and 1")
    (n0, mean0), (n1, mean1) = per_class[0], per_class[1]
    n = n0 + n1
    total_variance = data.agg(Summarizer.variance(F.col("x"))).first()[0].toArray().sum()
    pca = PCA(k=len(mean0), inputCol="x", outputCol="z").fit(data)
    axes = pca.pc.toArray()
    scatter = (axes * (pca.explainedVariance.toArray() * total_variance * (n - 1))) @ axes.T
    data.unpersist()
    gap = mean1 - mean0
    within = (scatter - (n0 * n1 / n) * np.outer(gap, gap)) / (n - 2)
    coefficients = np.linalg.pinv(within, rcond=1e-10, hermitian=True) @ gap
    middle = (mean0 + mean1) / 2
    intercept = -coefficients @ middle + np.log(priors[1] / priors[0])
    return DiscriminantModel(coefficients, float(intercept))
