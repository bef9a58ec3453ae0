"""Packing documents into sequences: dominance reduction, then best fit for the rest.

Only the length of a piece matters to a packing, so the instance is a histogram with one
count per length up to the capacity: it has a fixed size however many pieces there are, and
that is all the driver sees. Martello and Toth's reduction takes the longest piece that is
left and looks for a small set of pieces to go with it that dominates every alternative: no
other choice could lead to fewer sequences. Such a set is fixed for good, as often as the
counts allow. When no set of up to three pieces can be proved to dominate, that length is left
to best fit and the reduction goes on with the next shorter one. Best fit takes the remaining
lengths in decreasing order and puts each into the fullest open sequence that holds it.

The outcome is a short list of patterns with multiplicities. Pieces get their places by rank
within their length, which the tasks that cut them have counted already.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import words
from gleaner.session import staged

_CACHED_WORDS = 400_000
_LONG_WORD = 256


@dataclass(frozen=True)
class PackingParams:
    """``tokenizer`` is the path of a tokenizer file on every executor."""

    tokenizer: str
    capacity: int = 2048
    end_id: int = 0


#: How the tokenizer file marks the last token of a piece.
_PIECE_END = "</w>"
_MARKS = b".,;:!?$%&*#"


def _marked(word: bytes) -> tuple[bytes, bytes]:
    """A word as letters and the marks behind them, if it can be cut there."""
    stem = word.rstrip(_MARKS)
    if len(stem) < len(word) and (stem.isalpha() or _normal(stem)[-1:].isalpha()):
        return stem, word[len(stem) :]
    return word, b""


def _normal(word: bytes) -> str:
    """The word as the tokenizer cuts it: composed and in lower case."""
    text = word.decode("utf-8", "replace")
    return text if text.isascii() else unicodedata.normalize("NFC", text).lower()


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never merges across it, so a text's ids are those of
    its words. Words are kept in a bounded cache, and those of a slice that are missing are
    encoded together. Only ASCII white space is cut at; the tokenizer sees any other kind.

    The tokenizer also cuts between letters and marks. So a word of letters with marks behind
    it is two entries, and words of letters, which are one piece each, are encoded as one text
    and told apart by the tokens that end a piece.
    """

    def __init__(self, path: str) -> None:
        # Spark runs a task per core already.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(_PIECE_END)]] = True

    def _encode(self, missing: list[bytes]) -> dict[bytes, bytes]:
        young, old = self.known, self.older
        found: dict[bytes, bytes] = {}
        cut: list[tuple[bytes, bytes, bytes]] = []
        letters: list[bytes] = []
        other: list[bytes] = []
        for word in missing:
            if word.isalpha():  # ASCII letters only
                letters.append(word)
                continue
            stem, marks = _marked(word)
            if marks:
                cut.append((word, stem, marks))
            else:
                (letters if _normal(word).isalpha() else other).append(word)
        for part in {p for _, *pair in cut for p in pair}.difference(letters):
            if part in young:
                found[part] = young[part]
            elif part in old:
                found[part] = old[part]
            else:
                (letters if part.isalpha() or _normal(part).isalpha() else other).append(part)
        found.update(self._encode_letters(letters))
        found.update(self._encode_each(other))
        for word, stem, marks in cut:
            found[word] = found[stem] + found[marks]
        return found

    def _encode_letters(self, letters: list[bytes]) -> dict[bytes, bytes]:
        lines = [letters[i : i + 512] for i in range(0, len(letters), 512)]
        texts = [b" ".join(line).decode() for line in lines]
        found: dict[bytes, bytes] = {}
        for line, one in zip(lines, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(one.ids, dtype="<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(line):  # some word is more than one piece
                found.update(self._encode_each(line))
                continue
            raw = ids.tobytes()
            begins = [0, *(4 * last[:-1]).tolist()]
            found.update(zip(line, (raw[a:b] for a, b in zip(begins, (4 * last).tolist(), strict=True)), strict=True))
        return found

    def _encode_each(self, missing: list[bytes]) -> dict[bytes, bytes]:
        texts = [w.decode("utf-8", "replace") for w in missing]
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return {
            w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(missing, encoded, strict=True)
        }

    def ids(self, texts: list[bytes]) -> list[bytes]:
        split = [t.lower().split() if b"<|" not in t else t.split() for t in texts]
        young, old = self.known, self.older
        encoded = [list(map(young.get, ws)) for ws in split]
        holes = [[i for i, e in enumerate(es) if e is None] for es in encoded]
        wanted = {ws[i] for ws, at in zip(split, holes, strict=True) for i in at}
        found = {w: old[w] for w in wanted if w in old}
        found.update(self._encode([w for w in wanted if w not in found]))
        for ws, es, at in zip(split, encoded, holes, strict=True):
            for i in at:
                es[i] = found[ws[i]]
        young.update(found)
        for w in [w for w in found if len(w) > _LONG_WORD]:
            del young[w]
        if len(young) > _CACHED_WORDS:
            # Words used since the last turn-over stay one turn longer.
            self.older, self.known = young, {}
        return [b"".join(es) for es in encoded]


def pieces(docs: DataFrame, doc_id: str, text: str, params: PackingParams) -> DataFrame:
    """Staged (doc_id, piece, start, length, ids_crc32, task, rank).

    A document is its ids and the end id; one that is longer than a sequence is cut into
    sequences and a rest. ``rank`` counts the pieces of the same length in the task so far.
    """
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("piece", pa.int32()),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("ids_crc32", pa.int64()),
            ("task", pa.int32()),
            ("rank", pa.int64()),
        ]
    )
    path, capacity = params.tokenizer, params.capacity
    end = np.array([params.end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        task = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for part in words.slices(batches, "text", 1 << 20):
            data, offsets = words.utf8(part.column("text"))
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            rows = []
            for key, ids in zip(part.column("doc_id").to_pylist(), encoder.ids(texts), strict=True):
                ids += end
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    one = ids[at : at + 4 * capacity]
                    length = len(one) // 4
                    rows.append((key, number, at // 4, length, zlib.crc32(one), task, seen[length]))
                    seen[length] += 1
            yield words.record(schema, *(list(c) for c in zip(*rows, strict=True)))

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
    return staged(read.mapInArrow(run, ddl), "pieces")


Pattern = tuple[tuple[int, ...], int]


class _Histogram:
    """Counts per length, with the searches the reduction needs."""

    def __init__(self, counts: np.ndarray) -> None:
        self.n = counts.astype(np.int64).copy()

    def largest(self, limit: int, without: tuple[int, ...] = ()) -> int:
        """The longest length up to ``limit`` that has a piece left beyond ``without``; 0 if none."""
        limit = min(limit, len(self.n) - 1)
        while limit > 0:
            found = np.flatnonzero(self.n[1 : limit + 1])
            if not len(found):
                return 0
            length = int(found[-1]) + 1
            if self.n[length] > without.count(length):
                return length
            limit = length - 1
        return 0

    def smallest(self, k: int, without: tuple[int, ...]) -> list[int]:
        """The ``k`` shortest pieces beyond ``without``."""
        out: list[int] = []
        for length in np.flatnonzero(self.n).tolist():
            out.extend([length] * min(k - len(out), int(self.n[length]) - without.count(length)))
            if len(out) >= k:
                break
        return out

    def above(self, length: int, k: int, without: tuple[int, ...]) -> list[int]:
        """The ``k`` shortest pieces that are longer than ``length``."""
        out: list[int] = []
        for longer in (np.flatnonzero(self.n[length + 1 :]) + length + 1).tolist():
            out.extend([longer] * min(k - len(out), max(0, int(self.n[longer]) - without.count(longer))))
            if len(out) >= k:
                break
        return out


def _dominating(held: _Histogram, capacity: int, j: int) -> tuple[int, ...] | None:
    """A set around a piece of length ``j`` that dominates all others, or None."""
    room = capacity - j
    short = held.smallest(3, (j,))
    fits = sum(1 for k in range(1, 4) if len(short) >= k and sum(short[:k]) <= room)
    if fits == 0:
        return (j,)
    best = held.largest(room, (j,))
    if fits == 1 or best == room:
        return (j, best)
    if fits > 2:
        return None
    # At most two more pieces fit: the fullest pair.
    pair, top = (0, 0), 0
    for a in np.flatnonzero(held.n[: room + 1])[::-1].tolist():
        if 2 * a < top or held.n[a] <= (a == j):
            continue
        b = held.largest(min(room - a, a), (j, a))
        if b and a + b > top:
            pair, top = (a, b), a + b
    a, b = pair
    if best >= top:
        return (j, best)
    if a == best:
        next_up = held.above(b, 2, (j, a))
        if len(next_up) < 2 or sum(next_up) > room:
            return (j, a, b)
    return None


def reduce_instance(counts: np.ndarray, capacity: int) -> tuple[list[Pattern], np.ndarray]:
    """Patterns fixed by dominance, and the counts of the pieces that are left.

    A length without a dominating set stays, and the walk goes on with the next shorter one;
    the pieces that stay count as alternatives there. A set is fixed as often as at least two
    pieces of each of its lengths remain, for as long the argument holds unchanged, and
    otherwise once.
    """
    held = _Histogram(counts)
    fixed: list[Pattern] = []
    longest = capacity
    while j := held.largest(longest):
        chosen = _dominating(held, capacity, j)
        if chosen is None:
            longest = j - 1
            continue
        times = min((int(held.n[x]) // chosen.count(x) for x in set(chosen)))
        if len(chosen) > 1 and sum(chosen) != capacity:
            times = max(1, min(int(held.n[x]) // chosen.count(x) - 3 for x in set(chosen)))
        for x in chosen:
            held.n[x] -= times
        fixed.append((chosen, times))
    return fixed, held.n


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit decreasing over a histogram: sequences filled alike are one entry."""
    open_: dict[int, list[list]] = {}  # room -> [[pattern, times], ...]
    done: list[Pattern] = []

    def put(pattern: tuple[int, ...], times: int) -> None:
        room = capacity - sum(pattern)
        if room:
            open_.setdefault(room, []).append([pattern, times])
        else:
            done.append((pattern, times))

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            rooms = [r for r in open_ if r >= length]
            if rooms:
                room = min(rooms)
                pattern, times = open_[room].pop()
                if not open_[room]:
                    del open_[room]
            else:
                room, pattern, times = capacity, (), left
            # The sequence just filled is the fullest, so it takes pieces while they fit.
            each = min(room // length, left)
            whole = min(times, left // each)
            put((*pattern, *[length] * each), whole)
            left -= whole * each
            if pattern and times > whole:
                open_.setdefault(room, []).append([pattern, times - whole])
    return done + [(tuple(p), n) for groups in open_.values() for p, n in groups]


def plan_patterns(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """All patterns of the packing: reduced ones first, then best fit."""
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _places(patterns: list[Pattern], capacity: int) -> dict[str, np.ndarray]:
    """For each length the intervals of ranks that a place in a pattern takes."""
    taken = np.zeros(capacity + 1, dtype=np.int64)
    rows = []
    first = 0
    for pattern, times in patterns:
        at = 0
        for length in pattern:
            rows.append((length, int(taken[length]), first, at))
            taken[length] += times
            at += length
        first += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(
    docs: DataFrame, params: PackingParams, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone, a row that repeats an id or has a null id is
    packed like any other, an empty table gives no rows. Other columns are not read.
    """
    cut = pieces(docs, doc_id, text, params)
    capacity = params.capacity
    per_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in histogram:  # at most one row per length
        counts[row["length"]] = row["n"]
    places = _places(plan_patterns(counts, capacity), capacity)
    shared = docs.sparkSession.sparkContext.broadcast(places)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select(
        F.col("length").alias("l"), F.col("task").alias("t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    same = (F.col("length") == F.col("l")) & (F.col("task") == F.col("t"))
    ranked = cut.join(offsets, same).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("first")).alias("rank")
    )
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("piece", pa.int32()),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("ids_crc32", pa.int64()),
            ("sequence_id", pa.int64()),
            ("offset", pa.int64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        begins = np.searchsorted(plan["length"], np.arange(capacity + 2))
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.empty(len(length), dtype=np.int64)
            for one in np.unique(length).tolist():
                own = length == one
                a, b = begins[one], begins[one + 1]
                at[own] = a + np.searchsorted(plan["rank"][a:b], rank[own], side="right") - 1
            sequence = plan["sequence"][at] + rank - plan["rank"][at]
            columns = [batch.column(i) for i in range(5)]
            yield words.record(schema, *columns, sequence, plan["offset"][at])

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(run, ddl)
