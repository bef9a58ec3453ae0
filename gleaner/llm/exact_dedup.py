"""Exact deduplication by a stateful stream over content fingerprints.

Every row becomes a small fingerprint: digest, identifier and content locator (input file
and row number). A stream folds fingerprints into keyed state on disk (RocksDB) that never
expires and holds per digest the first content seen, the identifier that stays and the
number of copies. Copies are folded inside the reading tasks first, so a text that makes up
a third of the table reaches its key as one row per task.

Equal digests alone decide nothing: texts whose digest was met before are compared byte by
byte, inside a task where they meet there and by grouping on the bytes otherwise. Should
different texts share a digest, their rows are grouped by the texts themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import bitmaps, words
from gleaner.session import new_path, staged

_STORE = "spark.sql.streaming.stateStore"
#: Keyed state on disk. Many small stores: no space reserved ahead, changes logged per batch,
#: and one bound for the memory outside the heap of all stores of an executor.
_STATE_CONF = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
    f"{_STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}.rocksdb.maxMemoryUsageMB": "64",
    f"{_STORE}.rocksdb.writeBufferSizeMB": "4",
}
_FLUSH_BYTES = 32 << 20


@dataclass(frozen=True)
class ExactDedupParams:
    """``digest_bytes`` shortens the digest only to test collisions; results stay the same."""

    files_per_batch: int = 64
    digest_bytes: int = 32
    bitmap_bits: int = 26


def fingerprints(docs: DataFrame, doc_id: str, text: str, params: ExactDedupParams) -> DataFrame:
    """One staged row per document: number, id, digests and the file that holds the content."""
    sha = F.sha2(words.lower_az(F.col(text)).cast("binary"), 256)
    rows = docs.select(F.col(doc_id).alias("doc_id"), sha.alias("text_sha256")).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "text_sha256",
        F.substring("text_sha256", 1, 2 * params.digest_bytes).alias("digest"),
        F.input_file_name().alias("file"),
    )
    return staged(rows, "fingerprints")


def stream_groups(arriving: DataFrame, out: str, checkpoint: str) -> None:
    """Fold a stream of fingerprints into state by digest; run until it has caught up.

    Each micro-batch writes the state of the digests it touched to its own folder, which a
    repeated batch overwrites. A later run with the same folders goes on from its state.
    """
    spark = arriving.sparkSession
    state = arriving.groupBy("digest").agg(
        F.count("*").alias("n"),
        # The row that stays: largest id, null ids last, then the first such row.
        F.max(F.struct("doc_id", (-F.col("row")).alias("minus_row"))).alias("keep"),
        F.min(F.struct("row", "doc_id", "file")).alias("first_seen"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    before = {key: spark.conf.get(key, None) for key in _STATE_CONF}
    for key, value in _STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    query.awaitTermination()


def _repeated_contents(
    docs: DataFrame, text: str, repeated: DataFrame, params: ExactDedupParams
) -> DataFrame:
    """(digest, content) of texts whose digest occurs more than once, copies folded by bytes."""
    slot = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    bitmap = bitmaps.collect_bitmap(repeated, slot, params.bitmap_bits)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    digits = min(15, 2 * params.digest_bytes)
    length = params.digest_bytes
    schema = pa.schema([("digest", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bytes], None] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            return words.record(
                schema, pa.array([d for d, _ in held]), pa.array([c for _, c in held], pa.binary())
            )

        for part in words.slices(batches, "text"):
            data, offsets = words.utf8(part.column("text"))
            lowered = words.lower_bytes(data)
            texts = [lowered[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            digests = [hashlib.sha256(t).hexdigest()[: 2 * length] for t in texts]
            slots = np.array([int(d[:digits], 16) for d in digests], dtype=np.uint64)
            for i in np.flatnonzero(bitmaps.contains(shared.value, slots)):
                key = (digests[i], texts[i])
                if key not in held:
                    held[key] = None
                    size += len(texts[i]) + 200
            if size > _FLUSH_BYTES:
                yield flush()
                held.clear()
                size = 0
        yield flush()

    read = docs.select(F.col(text).alias("text"))
    return read.mapInArrow(run, "digest string, content binary")


def _collided(
    docs: DataFrame, text: str, groups: DataFrame, params: ExactDedupParams
) -> DataFrame | None:
    """Digests that stand for more than one text, by full bytes; None if there are none."""
    repeated = groups.where("n > 1").select("digest")
    contents = _repeated_contents(docs, text, repeated, params)
    per_digest = contents.distinct().groupBy("digest").agg(F.count("*").alias("n_contents"))
    found = staged(per_digest.where("n_contents > 1").select("digest"), "collided")
    return None if found.isEmpty() else found


def dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    params: ExactDedupParams | None = None,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes agree after lower-casing A-Z; a null text is empty. Of
    equal texts the row with the largest id stays. Exactly one row of a group is kept: of
    rows that repeat the same id and text it is the first read, and a null id stays only if
    the whole group has none (``keep_id`` is null then). An empty table gives no rows. Other
    columns of ``docs`` are not read, whatever their names.
    """
    params = params or ExactDedupParams()
    spark = docs.sparkSession
    rows = fingerprints(docs, doc_id, text, params)
    source = rows.inputFiles()
    if not source:
        return rows.select(
            "doc_id",
            F.col("doc_id").alias("keep_id"),
            F.lit(0).cast("long").alias("group_size"),
            F.lit(False).alias("kept"),
            "text_sha256",
        ).where(F.lit(False))
    folder = source[0].rsplit("/", 1)[0]
    arriving = (
        spark.readStream.schema(rows.schema)
        .option("maxFilesPerTrigger", params.files_per_batch)
        .parquet(folder)
    )
    out = new_path(spark, "groups")
    stream_groups(arriving, out, new_path(spark, "dedup-state"))
    updates = spark.read.parquet(out)
    # The state of a digest only grows, so its last update is the one with most copies.
    groups = (
        updates.groupBy("digest")
        .agg(F.max(F.struct("n", "keep")).alias("last"))
        .select("digest", "last.n", "last.keep")
    )
    by_digest = rows.join(groups, "digest").select(
        "row", "doc_id", "text_sha256", "digest", F.col("n").alias("group_size"), "keep"
    )
    collided = _collided(docs, text, groups, params)
    if collided is not None:
        by_digest = by_digest.join(collided, "digest", "left_anti").unionByName(
            _by_text(docs, rows.join(collided, "digest", "left_semi"), doc_id, text)
        )
    return by_digest.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == -F.col("keep.minus_row")).alias("kept"),
        "text_sha256",
    )


def _by_text(docs: DataFrame, rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Groups of rows with a collided digest, by the texts themselves."""
    content = words.lower_az(F.col(text))
    texts = docs.select(
        F.col(doc_id).alias("id"), F.sha2(content.cast("binary"), 256).alias("sha"), content.alias("content")
    ).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_sha256") == F.col("sha"))
    found = rows.join(texts, same).select("row", "doc_id", "text_sha256", "digest", "content")
    keep = F.max(F.struct("doc_id", (-F.col("row")).alias("minus_row"))).alias("keep")
    groups = found.groupBy("content").agg(F.count("*").alias("group_size"), keep)
    return found.join(groups, "content").drop("content")


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``dedup`` keeps, with all their columns."""
    dropped = dedup(docs, doc_id, text).where(~F.col("kept"))
    sha = F.sha2(words.lower_az(F.col(text)).cast("binary"), 256)
    # Rows that repeat an id with the same text are dropped or kept together by a join.
    again = dropped.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    gone = dropped.where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    gone_id = words.free_name(docs.columns, "gone_id")
    gone_sha = words.free_name(docs.columns, "gone_sha")
    gone = gone.select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha))
    same = F.col(doc_id).eqNullSafe(F.col(gone_id)) & (sha == F.col(gone_sha))
    left = docs.join(gone.distinct(), same, "left_anti")
    if again.isEmpty():
        return left
    return left.withColumn(gone_sha, sha).dropDuplicates([doc_id, gone_sha]).drop(gone_sha)
