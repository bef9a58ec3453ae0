"""Fill-in-the-middle documents, cut at code points found in a set of character starts.

The bytes at which the characters of a UTF-8 text start form a set of integers. It is kept
in containers of 65,536 values each: as runs (start and length), as an array of values or as
a bitmap, whichever is smallest. With the members before each container summed up, the k-th
character's byte is found by a search over containers and a select inside one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm import words

PLAIN, PREFIX_FIRST, SUFFIX_FIRST = "plain", "psm", "spm"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_VALUES = 1 << 16
_BITMAP_BYTES = _VALUES // 8


@dataclass(frozen=True)
class FillMiddleParams:
    """``seed`` goes before the id; percentages of texts to transform, and of those suffix first."""

    seed: str = "1:"
    transformed_percent: int = 90
    suffix_first_percent: int = 20


class ArrayContainer:
    """Sorted 16-bit values."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values.astype(np.uint16)

    def nbytes(self) -> int:
        return self.values.nbytes

    def select(self, rank: int) -> int:
        return int(self.values[rank])


class RunContainer:
    """Runs of consecutive values: their first values and the members before each."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.starts = starts.astype(np.uint16)
        self.before = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int32)

    def nbytes(self) -> int:
        return self.starts.nbytes + self.before.nbytes

    def select(self, rank: int) -> int:
        run = int(np.searchsorted(self.before, rank, side="right")) - 1
        return int(self.starts[run]) + rank - int(self.before[run])


class BitmapContainer:
    """A bit per value, with the members before each block of 64 bytes."""

    _BLOCK = 64

    def __init__(self, flags: np.ndarray) -> None:
        full = np.zeros(_VALUES, dtype=bool)
        full[: len(flags)] = flags
        self.bits = np.packbits(full)
        per_block = full.reshape(-1, 8 * self._BLOCK).sum(axis=1)
        self.before = np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype(np.int32)

    def nbytes(self) -> int:
        return self.bits.nbytes + self.before.nbytes

    def select(self, rank: int) -> int:
        block = int(np.searchsorted(self.before, rank, side="right")) - 1
        own = np.unpackbits(self.bits[block * self._BLOCK : (block + 1) * self._BLOCK])
        place = int(np.flatnonzero(own)[rank - int(self.before[block])])
        return block * self._BLOCK * 8 + place


def container(flags: np.ndarray) -> ArrayContainer | RunContainer | BitmapContainer:
    """The smallest container for the members marked in a chunk of at most 65,536 flags."""
    edges = np.diff(flags.astype(np.int8), prepend=0, append=0)
    starts = np.flatnonzero(edges == 1)
    n = int(np.count_nonzero(flags))
    if 6 * len(starts) <= min(2 * n, _BITMAP_BYTES):
        return RunContainer(starts, np.flatnonzero(edges == -1) - starts)
    if 2 * n <= _BITMAP_BYTES:
        return ArrayContainer(np.flatnonzero(flags))
    return BitmapContainer(flags)


class BoundarySet:
    """The bytes of a UTF-8 text at which its characters start, and its end."""

    def __init__(self, data: np.ndarray) -> None:
        self.n_bytes = len(data)
        self.containers = []
        sizes = []
        for first in range(0, len(data), _VALUES):
            # Every byte that does not continue a character starts one.
            flags = (data[first : first + _VALUES] & 0xC0) != 0x80
            self.containers.append(container(flags))
            sizes.append(int(np.count_nonzero(flags)))
        self.cumulative = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def __len__(self) -> int:
        """Characters of the text."""
        return int(self.cumulative[-1])

    def nbytes(self) -> int:
        return sum(c.nbytes() for c in self.containers) + self.cumulative.nbytes

    def offset(self, character: int) -> int:
        """The byte where a character starts; the length in bytes for the one past the last."""
        if not 0 <= character <= len(self):
            raise IndexError(character)
        if character == len(self):
            return self.n_bytes
        chunk = int(np.searchsorted(self.cumulative, character, side="right")) - 1
        return chunk * _VALUES + self.containers[chunk].select(character - int(self.cumulative[chunk]))


def draws(doc_id: int | None, seed: str) -> list[int]:
    """Four 32-bit numbers from the digest of an id; a null id counts as empty."""
    text = seed + ("" if doc_id is None else str(doc_id))
    digest = hashlib.sha256(text.encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def rearrange(text: bytes, numbers: list[int], params: FillMiddleParams) -> tuple:
    """(characters, form, prefix characters, middle characters, output bytes) of one text."""
    boundaries = BoundarySet(np.frombuffer(text, dtype=np.uint8))
    n = len(boundaries)
    h1, h2, h3, h4 = numbers
    marked = any(mark.encode() in text for mark in (PREFIX, SUFFIX, MIDDLE))
    if n == 0 or marked or h3 % 100 >= params.transformed_percent:
        return n, PLAIN, None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = boundaries.offset(first), boundaries.offset(last)
    prefix = PREFIX.encode() + text[:a]
    suffix = SUFFIX.encode() + text[b:]
    middle = MIDDLE.encode() + text[a:b]
    suffix_first = h4 % 100 < params.suffix_first_percent
    form = SUFFIX_FIRST if suffix_first else PREFIX_FIRST
    output = suffix + prefix + middle if suffix_first else prefix + suffix + middle
    return n, form, first, last - first, output


def transform(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    params: FillMiddleParams | None = None,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): every row with its new text.

    A null text is empty; empty texts and texts that contain a mark stay plain, as do those
    beyond the transformed share. Rows that repeat come out alike; a null id draws as an
    empty one. Other columns are not read, whatever their names. Memory follows the longest
    text: some three times its bytes, and its set of boundaries (two bytes a run of ASCII).
    """
    params = params or FillMiddleParams()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"]])
    for name, kind in (("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.slices(batches, "text"):
            data, offsets = words.utf8(part.column("text"))
            ids = part.column("doc_id")
            found = [
                rearrange(data[a:b].tobytes(), draws(i, params.seed), params)
                for i, a, b in zip(ids.to_pylist(), offsets[:-1], offsets[1:], strict=True)
            ]
            n, form, prefix, middle, output = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(n, pa.int64()),
                    pa.array(form, pa.string()),
                    pa.array(prefix, pa.int64()),
                    pa.array(middle, pa.int64()),
                    # As the worker's texts are bounded by a slice or one text, so is this.
                    pa.array(output, pa.binary()).cast(pa.string()),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The original text from a transformed one and its form.

    Marks occur once each, because texts that contain one stay plain; a mark cannot arise
    across a seam, as only its first character is ``<`` and only its last ``>``.
    """
    out = F.col(output)
    middle = F.substring_index(out, MIDDLE, -1)
    ahead = F.substring_index(out, MIDDLE, 1)
    prefix_first = F.substring_index(ahead, SUFFIX, 1)
    prefix_last = F.substring_index(ahead, PREFIX, -1)
    prefix_of_first = F.substring_index(prefix_first, PREFIX, -1)
    suffix_last = F.substring_index(ahead, SUFFIX, -1)
    suffix_of_first = F.substring_index(F.substring_index(ahead, PREFIX, 1), SUFFIX, -1)
    return (
        F.when(F.col(form) == PREFIX_FIRST, F.concat(prefix_of_first, middle, suffix_last))
        .when(F.col(form) == SUFFIX_FIRST, F.concat(prefix_last, middle, suffix_of_first))
        .otherwise(out)
    )


def described(transformed: DataFrame) -> DataFrame:
    """The transformed rows with digests of output and restored text in place of the output."""
    return transformed.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(), 256).alias("restored_sha256"),
    )
