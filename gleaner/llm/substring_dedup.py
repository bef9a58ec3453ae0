"""Removal of passages that occur more than once, by suffix automata of reference shards.

A window of ``length`` words is repeated if the same words start anywhere else. Windows are
picked up by an anchor: the smallest hash among the window's short word sequences. Equal
windows have equal anchors, so a shard needs only the text around one range of anchors.

1. Two bitmaps of fixed size thin out the work: anchors that occur once, and windows that
   occur once, go no further. What they let through too much is decided below.
2. The stretches of the remaining windows around one anchor occurrence are the references.
   Equal ones are folded before they move, with their number of occurrences.
3. Every shard holds all references of its anchors and builds their suffix automaton, with
   the number of occurrences for each state. Streaming the same stretches through it gives
   the matching statistics at every word; where a match of ``length`` words has more than one
   occurrence, the window is repeated.
4. Documents lose all words that such windows cover: maximal spans of at least ``length``.

Shards get the stretches of their own anchors instead of all documents: a broadcast of every
automaton to every document would cost shards times documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import bitmaps, words
from gleaner.session import staged

_FLUSH_BYTES = 32 << 20


@dataclass(frozen=True)
class SubstringParams:
    """``anchor`` is the length of the short sequences, ``shard_words`` the size of a shard."""

    length: int = 35
    anchor: int = 8
    shard_words: int = 50_000
    bitmap_bits: int = 27


class SuffixAutomaton:
    """All word sequences of some references, with how often each occurs."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.times = [0]
        self.ended: list[tuple[int, int]] = []

    def add(self, reference: list, times: int) -> None:
        """Adds a reference that occurs ``times`` times."""
        follow, link, length = self.next, self.link, self.length
        last = 0
        for word in reference:
            known = follow[last].get(word)
            if known is not None and length[known] == length[last] + 1:
                last = known
            elif known is not None:
                last = self._clone(last, word, known)
            else:
                new = len(follow)
                follow.append({})
                length.append(length[last] + 1)
                link.append(0)
                self.times.append(0)
                at = last
                while at >= 0 and word not in follow[at]:
                    follow[at][word] = new
                    at = link[at]
                if at >= 0:
                    target = follow[at][word]
                    link[new] = target if length[target] == length[at] + 1 else self._clone(at, word, target)
                last = new
            self.times[last] += times

    def _clone(self, at: int, word: object, target: int) -> int:
        follow, link, length = self.next, self.link, self.length
        clone = len(follow)
        follow.append(dict(follow[target]))
        length.append(length[at] + 1)
        link.append(link[target])
        self.times.append(0)
        link[target] = clone
        while at >= 0 and follow[at].get(word) == target:
            follow[at][word] = clone
            at = link[at]
        return clone

    def close(self) -> None:
        """Adds up occurrences: a sequence occurs wherever a longer one that ends so does."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.times[self.link[state]] += self.times[state]

    def statistics(self, stream: list, least: int) -> list[tuple[int, int]]:
        """At each word the length of the longest match that ends there, cut to ``least``,
        and how often those words occur."""
        follow, link, length = self.next, self.link, self.length
        out = []
        state = matched = 0
        for word in stream:
            while state and word not in follow[state]:
                state = link[state]
                matched = length[state]
            if word in follow[state]:
                state = follow[state][word]
                matched += 1
            # Shorter matches behind the first ``least`` words say nothing new.
            while matched >= least and state and length[link[state]] >= least:
                state = link[state]
            matched = min(matched, max(least, length[link[state]] + 1) if state else 0)
            out.append((matched, self.times[state]))
        return out


@dataclass
class _Windows:
    """Windows of some texts by anchor: start word, anchor position and hash of each."""

    words: words.Words
    hashes: np.ndarray
    start: np.ndarray
    anchor: np.ndarray
    key: np.ndarray


def _windows(column: pa.Array, params: SubstringParams) -> _Windows:
    w = words.split(column, lower=False)
    h = w.hashes()
    n = len(h)
    none = np.empty(0, np.int64)
    if n < params.length:
        return _Windows(w, h, none, none, np.empty(0, np.uint64))
    at = np.arange(n - params.anchor + 1)
    grams = words.rolling(h, at, at + params.anchor)
    view = np.lib.stride_tricks.sliding_window_view(grams, params.length - params.anchor + 1)
    start = np.flatnonzero(w.text[: n - params.length + 1] == w.text[params.length - 1 :])
    anchor = start + view[start].argmin(axis=1)
    return _Windows(w, h, start, anchor, grams[anchor])


def _repeated_slots(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the slots that more than one hash fell into; ``hashes`` has (slot, n)."""
    twice = hashes.groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
    return bitmaps.collect_bitmap(twice, F.col("slot"), bits)


def _folded_slots(hashes: np.ndarray, bits: int) -> pa.RecordBatch:
    slots, n = np.unique(hashes & np.uint64((1 << bits) - 1), return_counts=True)
    schema = pa.schema([("slot", pa.int64()), ("n", pa.int32())])
    return words.record(schema, slots.view(np.int64), np.minimum(n, 2).astype(np.int32))


def _anchor_bitmap(docs: DataFrame, params: SubstringParams) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches, "text", 1 << 20):
            found = _windows(part.column("text"), params)
            first = np.ones(len(found.anchor), dtype=bool)
            first[1:] = found.anchor[1:] != found.anchor[:-1]
            yield _folded_slots(found.key[first], params.bitmap_bits)

    return _repeated_slots(docs.select("text").mapInArrow(run, "slot long, n int"), params.bitmap_bits)


def _window_bitmap(docs: DataFrame, anchors: Broadcast, params: SubstringParams) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches, "text", 1 << 20):
            found = _windows(part.column("text"), params)
            start = found.start[bitmaps.contains(anchors.value, found.key)]
            hashes = words.rolling(found.hashes, start, start + params.length)
            yield _folded_slots(hashes, params.bitmap_bits)

    return _repeated_slots(docs.select("text").mapInArrow(run, "slot long, n int"), params.bitmap_bits)


def _stretches(
    docs: DataFrame, anchors: Broadcast, windows: Broadcast, params: SubstringParams
) -> DataFrame:
    """Staged stretches of windows that passed both bitmaps, by anchor occurrence.

    Rows with ``stretch`` (its words) are references folded in their task, ``n`` of them;
    rows without say where one occurs: (doc_id, text_key, start).
    """
    schema = pa.schema(
        [
            ("anchor", pa.int64()),
            ("digest", pa.int64()),
            ("n", pa.int64()),
            ("stretch", pa.binary()),
            ("doc_id", pa.int64()),
            ("text_key", pa.int64()),
            ("start", pa.int32()),
        ]
    )
    length = params.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys, values = list(held), list(held.values())
            nulls = pa.nulls(len(keys), pa.int64())
            batch = words.record(
                schema,
                pa.array([k[0] for k in keys], pa.int64()),
                pa.array([k[1] for k in keys], pa.int64()),
                pa.array([v[0] for v in values], pa.int64()),
                pa.array([v[1] for v in values], pa.binary()),
                nulls,
                nulls,
                pa.nulls(len(keys), pa.int32()),
            )
            held.clear()
            return batch

        for part in words.slices(batches, "text", 1 << 20):
            found = _windows(part.column("text"), params)
            keep = bitmaps.contains(anchors.value, found.key)
            start, anchor, key = found.start[keep], found.anchor[keep], found.key[keep]
            keep = bitmaps.contains(windows.value, words.rolling(found.hashes, start, start + length))
            start, anchor, key = start[keep], anchor[keep], key[keep]
            if not len(start):
                continue
            new = np.ones(len(start), dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
            begins = np.flatnonzero(new)
            lasts = np.append(begins[1:], len(start)) - 1
            a, b = start[begins], start[lasts] + length
            digests = words.rolling(found.hashes, a, b).view(np.int64)
            keys = key[begins].view(np.int64)
            w = found.words
            raw, from_, to = w.data.tobytes(), w.start[a], w.end[b - 1]
            for k, d, x, y in zip(keys.tolist(), digests.tolist(), from_.tolist(), to.tolist(), strict=True):
                entry = held.get((k, d))
                if entry is None:
                    stretch = b" ".join(raw[x:y].split())
                    held[(k, d)] = [1, stretch]
                    size += len(stretch) + 200
                else:
                    entry[0] += 1
            first_word = w.firsts()[w.text[a]]
            owner = pa.array(w.text[a])
            yield words.record(
                schema,
                keys,
                digests,
                np.ones(len(a), np.int64),
                pa.nulls(len(a), pa.binary()),
                part.column("doc_id").take(owner),
                part.column("text_key").take(owner),
                (a - first_word).astype(np.int32),
            )
            if size > _FLUSH_BYTES:
                yield flush()
                size = 0
        yield flush()

    ddl = "anchor long, digest long, n long, stretch binary, doc_id long, text_key long, start int"
    return staged(docs.mapInArrow(run, ddl), "stretches")


def _judge(references: dict[tuple[int, int], list], length: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, digest, mask) for a shard: bit ``i`` tells that window ``i`` is repeated."""
    by_anchor: dict[int, list] = {}
    for (anchor, digest), (n, stretch) in references.items():
        by_anchor.setdefault(anchor, []).append((digest, n, stretch))
    automaton, streams = SuffixAutomaton(), []
    for anchor, own in by_anchor.items():
        if len(own) == 1:
            # Alone with its anchor: all windows occur as often as the stretch.
            digest, n, stretch = own[0]
            if n > 1:
                yield anchor, digest, (1 << (stretch.count(b" ") + 2 - length)) - 1
            continue
        for digest, n, stretch in own:
            stream = stretch.split(b" ")
            automaton.add(stream, n)
            streams.append((anchor, digest, stream))
    automaton.close()
    for anchor, digest, stream in streams:
        mask = 0
        for i, (matched, times) in enumerate(automaton.statistics(stream, length)[length - 1 :]):
            if matched >= length and times > 1:
                mask |= 1 << i
        if mask:
            yield anchor, digest, mask


def _verdicts(stretches: DataFrame, params: SubstringParams) -> DataFrame:
    """(anchor, digest, mask) of the stretches with a repeated window, shard by shard."""
    schema = pa.schema([("anchor", pa.int64()), ("digest", pa.int64()), ("mask", pa.int64())])

    def judged(shard: dict) -> pa.RecordBatch:
        rows = list(_judge(shard, params.length))
        return words.record(schema, *([r[i] for r in rows] for i in range(3)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: dict[tuple[int, int], list] = {}
        size, last = 0, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for anchor, digest, n, stretch in zip(*columns, strict=True):
                if anchor != last and size > params.shard_words:
                    yield judged(shard)
                    shard, size = {}, 0
                last = anchor
                entry = shard.get((anchor, digest))
                if entry is None:
                    shard[(anchor, digest)] = [n, stretch]
                    size += stretch.count(b" ") + 1
                else:
                    entry[0] += n
        yield judged(shard)

    references = stretches.where("stretch is not null").select("anchor", "digest", "n", "stretch")
    sharded = references.repartition("anchor").sortWithinPartitions("anchor")
    return sharded.mapInArrow(run, "anchor long, digest long, mask long")


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    params: SubstringParams | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (words joined by a space).

    Every word that a repeated window covers is removed, first occurrences too; windows are
    judged on the input. A null text has no words. Rows that repeat an id are documents of
    their own, and so are rows with a null id. Other columns of ``docs`` are not read. An
    anchor has at most 63 windows, so ``length`` may exceed ``anchor`` by 62 at most.
    """
    params = params or SubstringParams()
    if not 0 <= params.length - params.anchor <= 62:
        raise ValueError("length must be from anchor to anchor + 62")
    read = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text)).alias("text_key"),
        F.col(text).alias("text"),
    )
    context = docs.sparkSession.sparkContext
    anchors = context.broadcast(_anchor_bitmap(read, params))
    windows = context.broadcast(_window_bitmap(read, anchors, params))
    stretches = _stretches(read, anchors, windows, params)
    for bitmap in (anchors, windows):  # the stretches are staged
        bitmap.destroy()
    places = stretches.where("stretch is null").select("anchor", "digest", "doc_id", "text_key", "start")
    marks = staged(
        places.join(_verdicts(stretches, params), ["anchor", "digest"])
        .groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k"))
        .agg(F.collect_list(F.struct("start", "mask")).alias("marks")),
        "marks",
    )
    # Only texts that may have a mark are moved to meet theirs.
    marked = context.broadcast(bitmaps.collect_bitmap(marks, F.col("k"), params.bitmap_bits))

    def may_have_marks(part: pa.RecordBatch) -> np.ndarray:
        return bitmaps.contains(marked.value, part.column("text_key").to_numpy().view(np.uint64))

    def marked_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield part.filter(pa.array(may_have_marks(part)))

    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))
    joined = read.mapInArrow(marked_only, read.schema).join(marks, same, "left")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]
    )
    length = params.length

    def cut(part: pa.RecordBatch, marks: list) -> pa.RecordBatch:
        data, offsets = words.utf8(part.column("text"))
        raw = data.tobytes()
        n_words, n_removed, kept = [], [], []
        for i, found in enumerate(marks):
            own = raw[offsets[i] : offsets[i + 1]].split()
            left = own
            if found:
                cover = np.zeros(len(own) + 1, dtype=np.int64)
                for mark in found:
                    mask, at = mark["mask"], mark["start"]
                    while mask:
                        low = (mask & -mask).bit_length() - 1
                        cover[at + low] += 1
                        cover[at + low + length] -= 1
                        mask &= mask - 1
                left = [own[j] for j in np.flatnonzero(np.cumsum(cover)[:-1] == 0)]
            n_words.append(len(own))
            n_removed.append(len(own) - len(left))
            kept.append(b" ".join(left).decode("utf-8", "replace"))
        return words.record(schema, part.column("doc_id"), n_words, n_removed, kept)

    def without_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches, "text"):
            rest = part.filter(pa.array(~may_have_marks(part)))
            yield cut(rest, [None] * rest.num_rows)

    def with_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches, "text"):
            yield cut(part, part.column("marks").to_pylist())

    ddl = "doc_id long, n_words long, n_removed long, kept_text string"
    rest = read.mapInArrow(without_marks, ddl)
    return rest.unionByName(joined.select("doc_id", "text", "marks").mapInArrow(with_marks, ddl))
