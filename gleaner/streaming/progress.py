"""Streaming label events: the first label per item, kept as a log of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators.labeling import first_labels, session_eval


def stream_first_labels(
    events: DataFrame,
    out: str,
    checkpoint: str,
    id_col: str = "sample_id",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the first label of every item up to date.

    ``events`` has ``event_id, ts, label`` and the id. The state holds one row per labeled
    item. A micro-batch writes only the items whose first label changed, to its own folder
    (a repeated batch overwrites itself). ``trigger`` are the options of Spark's trigger; by
    default the stream ends when it has caught up.
    """

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_id={batch_id}")

    return (
        first_labels(events, id_col)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_labels(spark: SparkSession, out: str, id_col: str = "sample_id") -> DataFrame:
    """The latest state of the log: one label per item."""
    return (
        spark.read.parquet(out)
        .groupBy(id_col)
        .agg(F.max_by("label", "batch_id").alias("label"))
    )


def current_session(
    spark: SparkSession, out: str, scores: DataFrame, id_col: str = "sample_id", p: str = "p"
) -> DataFrame:
    """Accuracy, AUC and size of the session, by the labels that have arrived so far."""
    return session_eval(current_labels(spark, out, id_col), scores, id_col, p)
