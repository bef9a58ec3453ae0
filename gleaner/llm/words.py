"""Words of UTF-8 texts as numpy arrays, straight from Arrow buffers.

A word is a longest run of bytes outside ``\\x20\\x09-\\x0D``. Texts are handled in slices of
a few megabytes, so memory follows the slice (or the one longest text), not the table.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.session import staged

SLICE_BYTES = 1 << 19

#: Rows of one file have numbers of this many bits.
_FILE_ROW_BITS = 40

#: The text's name on its way to the Python workers, where a caller's names may clash.
_TEXT = "_text_of_row_"

_WORD_BYTE = np.ones(256, dtype=bool)
_WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a word."""
    return _WORD_BYTE[data]


def byte_values(data: np.ndarray) -> np.ndarray:
    """What each byte adds to the hash of a word."""
    return _BYTE_VALUE[data]


class _Powers:
    """Powers of an odd constant modulo 2**64, computed once as far as needed."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.known = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            grown = np.full(max(n, 2 * len(self.known)), self.base, dtype=np.uint64)
            grown[0] = 1
            self.known = np.cumprod(grown, dtype=np.uint64)
        return self.known[:n]


_POWERS, _INVERSES = _Powers(_BASE), _Powers(_BASE_INVERSE)


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run ``values[start:end]``; equal runs hash alike wherever they stand."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _POWERS.upto(n), dtype=np.uint64, out=sums[1:])
    inverse = _INVERSES.upto(n + 1)
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """The words of some texts: byte spans in ``data``, and the text each belongs to."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    n_texts: int

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word."""
        return rolling(_BYTE_VALUE[self.data], self.start, self.end)

    def counts(self) -> np.ndarray:
        """Words per text."""
        return np.bincount(self.text, minlength=self.n_texts)

    def firsts(self) -> np.ndarray:
        """Where each text's words begin, with the total at the end."""
        return np.concatenate([[0], np.cumsum(self.counts())])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(column: pa.Array, lower: bool) -> Words:
    """The words of every text; ``lower`` turns A-Z into a-z first."""
    data, offsets = utf8(column)
    if lower:
        data = _LOWER[data]
    inside = _WORD_BYTE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    text = np.searchsorted(offsets, starts, side="right") - 1
    return Words(data, starts, np.flatnonzero(end) + 1, text, len(column))


def lower(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


def lower_bytes(data: np.ndarray) -> bytes:
    """The bytes with A-Z in lower case."""
    return lower(data).tobytes()


def slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of about ``limit`` bytes of one text column.

    Python workers outlive their task: when all is read, unused memory goes back.
    """
    try:
        yield from _cut(batches, column, limit)
    finally:
        give_back_memory()


def give_back_memory() -> None:
    """Return what Arrow and the C library keep for later use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, returning unused memory at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back_memory()

    return wrapped


def _cut(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = utf8(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def in_batches(
    df: DataFrame,
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """``mapInArrow``, named for what the callers do."""
    return df.mapInArrow(giving_back(run), schema)


def lower_az(text: Column) -> Column:
    """Lower-case A-Z only, null as empty."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A batch from numpy or Arrow columns in schema order."""
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
        for c, f in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the number of values per row."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def with_columns(
    df: DataFrame,
    text: str,
    fields: dict[str, str],
    compute: Callable[[pa.Array], list],
    slice_bytes: int = SLICE_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` with columns computed from one text column, slice by slice.

    ``fields`` maps new names to SQL types; columns of ``df`` with such names are replaced.
    Only the columns in ``keep`` (all by default) and the text go to the Python workers, and
    only those in ``keep`` come back: Spark cannot prune a column that a worker returns.
    """
    clean = df.drop(*fields)
    keep = [c for c in clean.columns if keep is None or c in keep]
    kept = clean.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias(_TEXT))
    schema = T.StructType(kept.schema.fields[:-1])
    for name, kind in fields.items():
        schema = schema.add(T.StructType.fromDDL(f"{name} {kind}").fields[0])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, _TEXT, slice_bytes):
            new = [c if isinstance(c, pa.Array) else pa.array(c) for c in compute(part.column(_TEXT))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *new], names=names)

    return kept.mapInArrow(run, schema)


def described(
    df: DataFrame,
    text: str,
    name: str,
    fields: dict[str, str],
    compute: Callable[[pa.Array], list],
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``df`` with a struct ``name`` computed from one text column, slice by slice.

    Only the text goes to the Python workers and only the struct comes back; the row itself
    stays in the JVM.
    """
    kind = ", ".join(f"{f}: {k}" for f, k in fields.items())

    def run(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], names=[_TEXT])
        parts = [
            pa.StructArray.from_arrays(compute(part.column(0)), names=list(fields))
            for part in _cut(iter([batch]), _TEXT, slice_bytes)
        ]
        give_back_memory()
        if not parts:
            return pa.StructArray.from_arrays(compute(column.slice(0, 0)), names=list(fields))
        return pa.concat_arrays(parts)

    return df.withColumn(name, F.arrow_udf(run, f"struct<{kind}>")(F.col(f"`{text}`")))


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores ahead as keep it apart from the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame, number: str) -> DataFrame:
    """``docs`` with a column that tells its rows apart, the same in every scan.

    Rows of a plain Parquet table are numbered by file (in the order of the names) and place
    in the file. Any other table is written down first, because a scan made anew may be split
    in other ways. Numbers rise along the table and leave gaps.
    """
    plan = docs._jdf.queryExecution().analyzed().nodeName()
    if plan != "LogicalRelation" or not _has_places(docs):
        return staged(docs.withColumn(number, F.monotonically_increasing_id()), number)
    place = docs.metadataColumn("_metadata")
    name, first = free_name([*docs.columns, number], "file"), free_name([*docs.columns, number], "first")
    # As many names as the driver lists for the scan itself.
    names = sorted(r[0] for r in docs.select(place["file_path"]).distinct().collect())
    files = docs.sparkSession.createDataFrame(
        [(f, i << _FILE_ROW_BITS) for i, f in enumerate(names)], f"`{name}` string, `{first}` long"
    )
    # Written down, the table has a known size: Spark decides how to join it.
    placed = docs.withColumns({name: place["file_path"], number: place["row_index"]})
    placed = placed.join(staged(files, "files"), name)
    return placed.withColumn(number, F.col(first) + F.col(number)).drop(name, first)


def _has_places(docs: DataFrame) -> bool:
    """Whether the files of a scan tell the place of a row."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        return False
    return True


def id_bucket(doc_id: str, n: int) -> Column:
    """crc32 of an id written as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n
