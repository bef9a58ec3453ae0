"""Global ranks and running sums without a single-partition window.

A plain ``row_number() over (order by key)`` sends the whole table, or the whole of a hot
class, through one task. Here rows are cut into order-preserving buckets first; windows
run inside a bucket, and the (bounded) table of bucket totals carries the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import keys

_HASH_DIGITS = 3


def hash_rank(
    df: DataFrame, digest: str, id_col: str, by: Sequence[str] = (), out: str = "rank"
) -> DataFrame:
    """Rank (from 1) in the order of a hex digest column, per value of ``by``.

    The digest's first digits are uniform, so the 4096 buckets are even however uneven
    the classes in ``by`` are.
    """
    by = list(by)
    bucketed = df.withColumn("hash_bucket", keys.leading_bits(F.col(digest), _HASH_DIGITS))
    before = (
        Window.partitionBy(*by).orderBy("hash_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        bucketed.groupBy(*by, "hash_bucket")
        .agg(F.count("*").alias("in_bucket"))
        .select(
            *by, "hash_bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("offset")
        )
    )
    inside = Window.partitionBy(*by, "hash_bucket").orderBy(digest, id_col)
    return (
        bucketed.withColumn("in_rank", F.row_number().over(inside))
        .join(offsets, [*by, "hash_bucket"])
        .withColumn(out, F.col("in_rank") + F.col("offset"))
        .drop("hash_bucket", "in_rank", "offset")
    )


def order_buckets(df: DataFrame, value: str, n_buckets: int, out: str = "bucket") -> DataFrame:
    """Add an order-preserving bucket number with about equally many rows per bucket.

    Equal values always share a bucket, so callers fold them before they sort inside one.
    """
    probabilities = [i / n_buckets for i in range(1, n_buckets)]
    inner = sorted(set(df.approxQuantile(value, probabilities, 0.5 / n_buckets)))
    splits = [float("-inf"), *(inner or [0.5]), float("inf")]
    cut = Bucketizer(splits=splits, inputCol=value, outputCol=out).transform(df)
    # Whole numbers hash alike in windows and groups, which saves a shuffle between them.
    return cut.withColumn(out, F.col(out).cast("int"))
