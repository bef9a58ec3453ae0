"""Mixing sources to target weights by drawing fixed-length token blocks.

1. The documents of a source lie one behind the other on a line of tokens, which is cut into
   blocks of a fixed length (the source's block length; its last block may be shorter).
2. Every source has a target. The target in blocks is dealt to the output shards by a
   multinomial draw: given the totals, the source counts of a shard are multinomial.
3. A source numbers its drawn slots through all shards. Slot ``t`` takes block
   ``permutation(t mod n_blocks)`` of round ``t div n_blocks``, where the permutation is a
   seeded pseudorandom bijection on block numbers (a Feistel network with cycle walking):
   no list of blocks is ever shuffled or held.
4. Slots and documents meet by joining on (source, block).

A block is used at most once per round, so a target of at most ``max_repeat`` times the
source's size never takes a document more often than that. Everything follows from the seed
and the rows, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import words
from gleaner.session import staged

_WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    """Block length follows the source: ``1 / blocks_per_source`` of it, at most ``block``."""

    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    max_repeat: int = 3
    block: int = 1024
    blocks_per_source: int = 512
    shard_tokens: int = 1 << 22
    chunk_documents: int = 4096
    seed: int = 17


def sized(docs: DataFrame, doc_id: str, text: str, source: str, row: str | None) -> DataFrame:
    """(row, doc_id, source, size): the number of words of every document, staged."""
    read = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.col(text).alias("text"),
    )

    # Counted in the JVM: no text goes to a Python worker.
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    return staged(read.select("row", "doc_id", "source", size.alias("size")), "sizes")


def targets(sizes: DataFrame, params: MixParams) -> DataFrame:
    """(source, source_size, n_documents, target, block, n_blocks, n_slots) per source.

    Water filling: a source takes ``level * weight`` but at most ``max_repeat`` times its
    size, where the level makes the targets add up to all sizes. One row per source passes
    through the windows here.
    """
    per_source = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_documents")
    )
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in params.weights])
    weighted = per_source.withColumn("place", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(cycle, (F.col("place") % len(params.weights) + 1).cast("int"))
    )
    cap = F.col("source_size") * float(params.max_repeat)
    filled = Window.orderBy(F.col("full_at"), "place")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    rest = filled.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    levels = (
        weighted.withColumn("cap", cap)
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.sum("weight").over(rest))
        # It holds at the first source that it does not fill, and only sinks behind it.
        .withColumn("level", F.when(F.col("level") <= F.col("full_at"), F.col("level")))
        .withColumn("level", F.max("level").over(everything))
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    block = F.greatest(
        F.lit(1),
        F.least(F.lit(params.block), F.floor(F.col("source_size") / params.blocks_per_source)),
    ).cast("long")
    return (
        levels.withColumn("target", target)
        .withColumn("block", block)
        .withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
        .withColumn("n_slots", F.round(F.col("target") / F.col("block")).cast("long"))
        .withColumn("n_slots", F.least("n_slots", F.col("n_blocks") * params.max_repeat))
        .select("source", "source_size", "n_documents", "target", "block", "n_blocks", "n_slots", "total")
    )


def placed(sizes: DataFrame, plan: DataFrame, params: MixParams) -> DataFrame:
    """``sizes`` with each document's offset on the line of its source.

    A source is cut into chunks by a hash of the row, so no window holds a whole source.
    """
    n_chunks = F.ceil(F.col("n_documents") / params.chunk_documents)
    chunk = F.pmod(F.xxhash64(F.lit(params.seed), "row"), n_chunks.cast("long"))
    rows = sizes.join(
        plan.select(F.col("source").alias("s"), "n_documents"),
        F.col("source").eqNullSafe(F.col("s")),
    ).withColumn("chunk", chunk)
    inside = Window.partitionBy("source", "chunk").orderBy("row")
    chunk_order = Window.partitionBy("source").orderBy("chunk")
    before = chunk_order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("source", "chunk")
        .agg(F.sum("size").alias("chunk_size"))
        .select(
            F.col("source").alias("s2"),
            F.col("chunk").alias("c2"),
            F.coalesce(F.sum("chunk_size").over(before), F.lit(0)).alias("chunk_offset"),
        )
    )
    same = F.col("source").eqNullSafe(F.col("s2")) & (F.col("chunk") == F.col("c2"))
    return (
        rows.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
        .join(offsets, same)
        .withColumn("offset", F.col("chunk_offset") + F.col("inside"))
        .select("row", "doc_id", "source", "size", "offset")
    )


def _permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed bijection of 0..n-1: a Feistel network over enough bits, walked into range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    keys = words.mix64(np.arange(1, 5, dtype=np.uint64) + np.uint64(key % (1 << 63)))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (words.mix64(right + k) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def slots(plan: DataFrame, params: MixParams) -> DataFrame:
    """(source, shard, slot, round, block): what every slot of every shard takes.

    A source's slots are made in ranges of bounded length, spread over the tasks.
    """
    n_shards = F.greatest(F.lit(1), F.ceil(F.col("total") / params.shard_tokens)).cast("int")
    step = 1 << 16
    ranges = (
        plan.where("n_slots > 0 and n_blocks > 0")
        .withColumn("n_shards", n_shards)
        .withColumn("key", F.xxhash64(F.lit(params.seed), F.coalesce("source", F.lit("\0null"))))
        .select(
            "source",
            "n_blocks",
            "n_slots",
            "n_shards",
            "key",
            F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / step))).alias("part"),
        )
        .repartition("source", "part")
    )
    schema = pa.schema(
        [("source", pa.string()), ("shard", pa.int32()), ("slot", pa.int64()), ("round", pa.int32()), ("block", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                # The same draw wherever a range of the source is made.
                draw = np.random.default_rng(r["key"] % (1 << 63))
                counts = draw.multinomial(r["n_slots"], np.full(r["n_shards"], 1 / r["n_shards"]))
                ends = np.cumsum(counts)
                first = r["part"] * step
                slot = np.arange(first, min(first + step, r["n_slots"]), dtype=np.int64)
                round_ = slot // r["n_blocks"]
                block = np.empty(len(slot), dtype=np.int64)
                for one in np.unique(round_):
                    at = round_ == one
                    key = (r["key"] + int(one)) % (1 << 63)
                    block[at] = _permuted(slot[at] % r["n_blocks"], r["n_blocks"], key)
                yield words.record(
                    schema,
                    pa.array([r["source"]] * len(slot), pa.string()),
                    np.searchsorted(ends, slot, side="right").astype(np.int32),
                    slot,
                    round_.astype(np.int32),
                    block,
                )

    return ranges.mapInArrow(run, "source string, shard int, slot long, round int, block long")


def pieces(documents: DataFrame, plan: DataFrame) -> DataFrame:
    """(row, source, block, start, length): the part of each block that a document fills."""
    blocks = plan.select(F.col("source").alias("s"), F.col("block").alias("block_length"))
    length = F.col("block_length")
    end = F.col("offset") + F.col("size")
    first = F.floor(F.col("offset") / length)
    last = F.floor((end - 1) / length)
    cut = (
        documents.where("size > 0")
        .join(blocks, F.col("source").eqNullSafe(F.col("s")))
        .select("row", "source", "offset", "size", "block_length", F.explode(F.sequence(first, last)).alias("block"))
    )
    begins = F.greatest(F.col("offset"), F.col("block") * length)
    stops = F.least(end, (F.col("block") + 1) * length)
    return cut.select(
        "row", "source", "block", (begins - F.col("offset")).alias("start"), (stops - begins).alias("length")
    )


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    row: str | None = None,
    params: MixParams | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The mix as (documents, drawn).

    ``documents`` has a row per document: row, doc_id, source, size, source_size, target and
    taken (words the mix takes, repeats counted). ``drawn`` has a row per document piece in
    the mix: row, source, shard, slot, round, block, start and length in words. A null text
    has size 0 and is never taken, a null source is a source of its own (the last), rows that
    repeat an id are separate documents, and an empty table gives two empty results. ``row``
    may name a column that numbers the rows; other columns of ``docs`` are not read.
    """
    params = params or MixParams()
    sizes = sized(docs, doc_id, text, source, row)
    plan = staged(targets(sizes, params), "targets")
    documents = staged(placed(sizes, plan, params), "placed")
    cut = pieces(documents, plan)
    chosen = slots(plan, params).withColumnRenamed("source", "s").withColumnRenamed("block", "b")
    drawn = cut.join(chosen, _same("source", "s") & (F.col("block") == F.col("b"))).drop("s", "b")
    taken = drawn.groupBy(F.col("row").alias("r")).agg(F.sum("length").alias("taken"))
    shares = plan.select(F.col("source").alias("s"), "source_size", "target")
    per_document = (
        documents.join(shares, _same("source", "s"))
        .join(taken, F.col("row") == F.col("r"), "left")
        .select(
            "row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
        )
    )
    return per_document, drawn


def mixed_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    params: MixParams | None = None,
) -> DataFrame:
    """The mix as documents, with the columns of ``docs``.

    Each round in which blocks of a document are drawn gives one row that holds the drawn
    words: the unchanged text if all were drawn, otherwise the drawn stretches joined by a
    space. A column ``n_chars`` is counted anew. Documents that were not drawn are left out.
    """
    number = words.free_name(docs.columns, "row")
    spans = words.free_name([*docs.columns, number], "drawn")
    numbered = words.numbered(docs, number)
    _, drawn = mix(numbered, doc_id, text, source, number, params)
    stretch = F.sort_array(F.collect_list(F.struct("start", "length"))).alias(spans)
    rounds = drawn.groupBy(F.col("row").alias(number), "round").agg(stretch)
    rounds = rounds.select(number, spans)

    def cut(column: pa.Array, drawn_: pa.Array) -> list[str | None]:
        w = words.split(column, lower=False)
        firsts = w.firsts()
        out = []
        for i, spans in enumerate(drawn_.to_pylist()):
            parts: list[list[int]] = []
            for span in spans:
                begin, end = span["start"], span["start"] + span["length"]
                if parts and parts[-1][1] == begin:
                    parts[-1][1] = end
                else:
                    parts.append([begin, end])
            if parts == [[0, firsts[i + 1] - firsts[i]]]:
                out.append(column[i].as_py())
                continue
            texts = [
                w.data[w.start[firsts[i] + a] : w.end[firsts[i] + b - 1]].tobytes() for a, b in parts
            ]
            out.append(b" ".join(texts).decode("utf-8", "replace"))
        return out

    taken = numbered.join(rounds, number).drop(number)
    place = taken.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches, text):
            columns = part.columns
            columns[place] = pa.array(cut(columns[place], part.column(spans)), pa.string())
            yield pa.RecordBatch.from_arrays(columns[:-1], names=part.schema.names[:-1])

    mixed = taken.mapInArrow(run, taken.drop(spans).schema)
    return mixed.withColumn("n_chars", F.length(text).cast("long")) if "n_chars" in docs.columns else mixed
