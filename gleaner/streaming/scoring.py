"""Streaming extraction, scoring and routing of newly arriving items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators import routing


def routed_so_far(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """Everything a ``stream_score`` job has written; ``schema`` covers an empty folder."""
    try:
        return spark.read.schema(schema).parquet(out)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stream_score(
    items: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    id_col: str = "sample_id",
    positive: float = routing.POSITIVE_THRESHOLD,
    negative: float = routing.NEGATIVE_THRESHOLD,
    event_time: str | None = None,
    watermark: str = "1 day",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score and route each new item of a stream once.

    ``score`` maps items to ``(id, p)``. Ids that have been seen are kept in the stream's
    state, so a batch reads nothing but what arrives; of rows that repeat an id the first to
    be processed counts. With an ``event_time`` column the state lets go of ids older than
    the ``watermark``; without one it grows with the ids, on disk if the session's state
    store is. Every micro-batch overwrites its own folder ``batch_id=...``, so a repeated
    batch leaves the same result. ``trigger`` are the options of Spark's trigger; by default
    the stream ends when it has caught up.
    """
    if event_time:
        fresh = items.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark([id_col])
    else:
        fresh = items.dropDuplicates([id_col])

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = score(batch).select(id_col, "p")
        # Items between the thresholds are written with a null route: they are done too.
        routed = routing.route_items(scored, positive, negative, keep_unrouted=True)
        routed.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_id={batch_id}")

    return (
        fresh.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
