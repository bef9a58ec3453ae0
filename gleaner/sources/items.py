"""Scanning item folders into ``items(sample_id, path, content)``."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import keys

ITEMS_FOLDER = "images"
ITEMS_SCHEMA = "sample_id string, path string, content binary"


def _files(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        files = (
            spark.read.format("binaryFile").option("pathGlobFilter", "*.*").load(folder)
        )
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return None if files.select("path").isEmpty() else files


def scan_items(spark: SparkSession, folder: str) -> DataFrame:
    """Files with a dot in their name, directly in ``folder`` or else in its ``images/``.

    A folder without any gives an empty table of the same schema. Content is only read
    from storage when a later step uses that column.
    """
    folder = folder.rstrip("/")
    for place in (folder, f"{folder}/{ITEMS_FOLDER}"):
        files = _files(spark, place)
        if files is not None:
            return files.select(keys.sample_id("path").alias("sample_id"), "path", "content")
    return spark.createDataFrame([], ITEMS_SCHEMA)


def items_from_table(df: DataFrame, path_col: str, content_col: str | None = None) -> DataFrame:
    """Items from any table that has a path-like column."""
    content = F.col(content_col) if content_col else F.lit(None).cast("binary")
    return df.select(
        keys.sample_id(path_col).alias("sample_id"),
        F.col(path_col).alias("path"),
        content.alias("content"),
    )


def id_collisions(items: DataFrame) -> DataFrame:
    """Sample ids shared by several items, with the number of items."""
    return (
        items.groupBy("sample_id").agg(F.count("*").alias("n_items")).where("n_items > 1")
    )


def normalize_layout(spark: SparkSession, folder: str, out: str) -> str:
    """Write the items of ``folder`` as a Parquet dataset ``out/images``.

    The input folder stays as it is; the feature store of the same dataset goes beside
    the items, at ``out/pretrained_features``. Returns the items path.
    """
    target = f"{out.rstrip('/')}/{ITEMS_FOLDER}"
    scan_items(spark, folder).write.mode("overwrite").parquet(target)
    return target
