"""The feature store: ``features(sample_id, model, vec)``, Parquet partitioned by model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORE_SCHEMA = "sample_id string, vec array<double>, model string"


class FeatureStore:
    """Compute-once storage of one vector per (item, model)."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "string"):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = STORE_SCHEMA.replace("sample_id string", f"sample_id {id_type}")

    def read(self, models: Sequence[str] | None = None) -> DataFrame:
        """Stored features; naming the models prunes the scan to their partitions."""
        try:
            stored = self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = self.spark.createDataFrame([], self.schema)
        if models is not None:
            stored = stored.where(F.col("model").isin(list(models)))
        return stored.select("sample_id", "model", "vec")

    def pending(self, items: DataFrame, model: str) -> DataFrame:
        """Items that have no stored vector of ``model`` yet."""
        return pending_items(items, self.read([model]), model)

    def append(self, features: DataFrame) -> None:
        """Add new vectors; callers pass only pending pairs."""
        (
            features.select("sample_id", "vec", "model")
            .write.mode("append")
            .partitionBy("model")
            .parquet(self.path)
        )


def pending_items(items: DataFrame, features: DataFrame, model: str) -> DataFrame:
    """Items without a vector of ``model`` among ``features``."""
    done = features.where(F.col("model") == model).select("sample_id")
    return items.join(done, "sample_id", "left_anti")


def labeled_set(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Both classes stacked, label 1.0 for the positive and 0.0 for the negative set."""
    return positive.withColumn("label", F.lit(1.0)).unionByName(
        negative.withColumn("label", F.lit(0.0))
    )
