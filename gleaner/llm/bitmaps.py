"""Fixed-size bitmaps that thin out rows before a join; what they let through is checked later.

The size is a parameter, never the data's: a fuller bitmap only lets more rows through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNK_BITS = 10


def collect_bitmap(slots: DataFrame, slot: Column, bits: int) -> np.ndarray:
    """A bitmap of ``2**bits`` bits as 64-bit words with the bit of every row's slot set.

    The executors put words and then chunks of words together; the driver gets the finished
    chunks, ``2**bits / 8`` bytes at most.
    """
    words = (
        slots.select(slot.bitwiseAND((1 << bits) - 1).alias("slot"))
        .select(
            F.shiftright("slot", 6).alias("word"),
            F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"),
        )
        .groupBy("word")
        .agg(F.bit_or("bit").alias("mask"))
    )
    chunks = words.groupBy(F.shiftright("word", _CHUNK_BITS).alias("chunk")).agg(
        F.collect_list(F.struct("word", "mask")).alias("words")
    )
    size = min(1 << _CHUNK_BITS, 1 << (bits - 6))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filled = []
            for entry in batch.column("words"):
                word, mask = (entry.values.field(i).to_numpy() for i in range(2))
                part = np.zeros(size, dtype=np.int64)
                part[word & (size - 1)] = mask
                filled.append(part.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk"), pa.array(filled, pa.binary())], names=["chunk", "filled"]
            )

    bitmap = np.zeros(1 << (bits - 6), dtype=np.uint64)
    for row in chunks.mapInArrow(fill, "chunk long, filled binary").collect():
        first = row["chunk"] << _CHUNK_BITS
        bitmap[first : first + size] = np.frombuffer(row["filled"], dtype=np.uint64)
    return bitmap


def contains(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the slot of each unsigned 64-bit hash is set."""
    slot = hashes & np.uint64(64 * len(bitmap) - 1)
    word = bitmap[(slot >> np.uint64(6)).astype(np.int64)]
    return (word >> (slot & np.uint64(63))) & np.uint64(1) == 1
