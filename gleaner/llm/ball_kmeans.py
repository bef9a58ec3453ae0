"""Codes of vector parts by product quantisation, the codebooks fitted by ball k-means.

A vector is cut into equal consecutive parts; each part position has a small codebook. In
every round a part's entry is a ball: its members and their largest distance to it. Only
entries nearer than twice that radius are its neighbours. A member nearer to its entry than
half the way to the next one lies in the stable core and is not compared at all; the others
lie in rings, and a member of the k-th ring meets the k nearest neighbours only. All numbers
are integers, so the bounds are exact and the result is that of comparing every part with
every entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import words
from gleaner.session import staged

#: Components below this in size keep squared distances of 2**10 of them within 64 bits.
_EXACT_IN_64_BITS = 1 << 25
#: Rows whose balls are handled together in a task.
_ROWS_AT_ONCE = 16384
_LARGEST = (1 << 63) - 1


@dataclass(frozen=True)
class BallKMeansParams:
    """``scale`` turns components into integers; ``parts`` must divide the vectors' width."""

    scale: float = 4096.0
    parts: int = 8
    entries: int = 16
    rounds: int = 6


@dataclass
class Effort:
    """Distances between parts and entries that a search looked at, and parts it looked at."""

    parts: int = 0
    own: int = 0
    others: int = 0
    in_core: int = 0


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis."""
    gap = a - b
    return (gap * gap).sum(axis=-1)


def reassign(
    points: np.ndarray, entries: np.ndarray, before: np.ndarray, effort: Effort | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each point and its squared distance; ties go to the lower entry.

    ``before`` holds any entry for each point; the nearer it is, the less work there is.
    """
    effort = effort or Effort()
    code = before.copy()
    best = _squares(points, entries[before])
    effort.parts += len(points)
    effort.own += len(points)
    between = _squares(entries[:, None, :], entries[None, :, :])
    for own in range(len(entries)):
        members = np.flatnonzero(before == own)
        if not len(members):
            continue
        others = np.array([j for j in range(len(entries)) if j != own], dtype=np.int64)
        # An entry is a neighbour if half its distance is within the ball's radius.
        reach = 4 * best[members]
        others = others[between[own, others] <= reach.max()]
        others = others[np.argsort(between[own, others], kind="stable")]
        ring = np.searchsorted(between[own, others], reach, side="right")
        effort.in_core += int((ring == 0).sum())
        for k, other in enumerate(others):
            outer = members[ring > k]
            if not len(outer):
                break
            effort.others += len(outer)
            away = _squares(points[outer], entries[other])
            nearer = (away < best[outer]) | ((away == best[outer]) & (other < code[outer]))
            code[outer[nearer]], best[outer[nearer]] = other, away[nearer]
    return code, best


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """A list column as rows of ``size`` integers, of 64 bits if their squares fit in those."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)
    exact = not flat.size or (flat.min() > -_EXACT_IN_64_BITS and flat.max() < _EXACT_IN_64_BITS)
    return flat if exact and size <= 1024 else flat.astype(object)


def _decimals(numbers: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Whole numbers of any size as decimals."""
    if numbers.dtype == object:
        return pa.array([Decimal(int(x)) for x in numbers], kind)
    return pa.array(numbers).cast(kind)


def _usable(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: float) -> DataFrame:
    """(vec_id, label, v) of the rows whose vector has only finite components."""
    whole = F.transform(F.col("vec"), lambda e: F.floor(e.cast("double") * F.lit(scale)))
    finite = F.forall(
        F.col("vec"),
        lambda e: F.coalesce(~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))), F.lit(False)),
    )
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vec")
    )
    return rows.where(F.col("vec").isNotNull() & finite).select("vec_id", "label", whole.alias("v"))


def first_codebooks(usable: DataFrame, params: BallKMeansParams) -> np.ndarray | None:
    """Codebooks (part, entry, position) from the rows with the smallest ids; None without rows.

    Rows that share an id come in the order of their components; null ids come last.
    """
    rows = usable.orderBy(F.asc_nulls_last("vec_id"), "v").limit(params.entries).collect()
    if not rows:
        return None
    widths = {len(row["v"]) for row in rows}
    if len(widths) > 1 or not next(iter(widths)) or next(iter(widths)) % params.parts:
        raise ValueError(f"vectors of widths {sorted(widths)} cannot be cut into {params.parts} equal parts")
    books = np.array([row["v"] for row in rows], dtype=object)
    return books.reshape(len(rows), params.parts, -1).transpose(1, 0, 2)


def _advance(state: DataFrame, books: np.ndarray, params: BallKMeansParams) -> DataFrame:
    """Rows with new codes and errors, and one row of partial sums for each task.

    A task's row of sums has a null ``v``; ``sums`` then holds, by part and entry, the number
    of members and the sum of each component.
    """
    n_parts, n_entries, width = books.shape
    size = n_parts * width
    shared = state.sparkSession.sparkContext.broadcast(books)
    kinds = {f.name: f.dataType for f in state.schema.fields}
    keep = ["vec_id", "label", "v"]
    schema = state.select(*keep).withColumns(
        {
            "code": F.lit(None).cast("binary"),
            "error": F.lit(None).cast("decimal(38,0)"),
            "sums": F.lit(None).cast("array<decimal(38,0)>"),
        }
    ).schema
    decimal = pa.decimal128(38, 0)
    coded = "code" in kinds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        small = abs(books).max() < _EXACT_IN_64_BITS if books.size else True
        narrow = books.astype(np.int64) if small else books
        sums = np.zeros((n_parts, n_entries, 1 + width), dtype=object)
        types = None
        for batch in batches:
            types = [batch.column(name).type for name in keep]
            for first in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.slice(first, _ROWS_AT_ONCE)
                n = part.num_rows
                if not n:
                    continue
                points = _matrix(part.column("v"), size)
                own = books if points.dtype == object else narrow
                points = points.reshape(n, n_parts, width)
                before = np.zeros((n, n_parts), dtype=np.int64)
                if coded:
                    before = words.utf8(part.column("code"))[0].reshape(n, n_parts).astype(np.int64)
                error = np.zeros(n, dtype=points.dtype)
                code = np.empty((n, n_parts), dtype=np.uint8)
                for p in range(n_parts):
                    found, away = reassign(points[:, p], own[p], before[:, p])
                    code[:, p], error = found, error + away
                    for e in np.unique(found):
                        members = points[found == e, p]
                        sums[p, e, 0] += len(members)
                        sums[p, e, 1:] += members.sum(axis=0).astype(object)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(name) for name in keep),
                        pa.Array.from_buffers(pa.binary(n_parts), n, [None, pa.py_buffer(code)]).cast(pa.binary()),
                        _decimals(error, decimal),
                        pa.nulls(n, pa.list_(decimal)),
                    ],
                    names=schema.names,
                )
        if types is not None:
            total = [Decimal(int(x)) for x in sums.reshape(-1)]
            empty = [pa.nulls(1, t) for t in types]
            yield pa.RecordBatch.from_arrays(
                [*empty, pa.nulls(1, pa.binary()), pa.nulls(1, decimal), pa.array([total], pa.list_(decimal))],
                names=schema.names,
            )

    columns = [*keep, "code"] if coded else keep
    rows = state.where("v is not null").select(*columns)
    return rows.mapInArrow(run, schema)


def _replaced(books: np.ndarray, advanced: DataFrame) -> np.ndarray:
    """Every entry as the floor of its members' mean; entries without members stay.

    The tasks' sums are added up by place, so a fixed number of rows reaches the driver.
    """
    sums = advanced.where("sums is not null").select(F.posexplode("sums").alias("place", "x"))
    added = sums.groupBy("place").agg(F.sum("x").cast("decimal(38,0)").alias("x")).collect()
    n_parts, n_entries, width = books.shape
    total = np.zeros(n_parts * n_entries * (1 + width), dtype=object)
    for row in added:
        total[row["place"]] = int(row["x"])
    total = total.reshape(n_parts, n_entries, 1 + width)
    after = books.copy()
    for p, e in np.argwhere(total[:, :, 0] > 0):
        after[p, e] = [x // total[p, e, 0] for x in total[p, e, 1:]]
    return after


@dataclass(frozen=True)
class Coded:
    """``rows`` of (vec_id, label, v, code, error) and the codebooks (part, entry, position)."""

    rows: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all entries' components in order, as decimal numbers with commas."""
        return hashlib.sha256(",".join(str(int(x)) for x in self.codebooks.reshape(-1)).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    params: BallKMeansParams | None = None,
) -> Coded:
    """Fit the codebooks on all rows and code every row.

    Rows whose vector is null or has a null or non-finite component take no part. Vectors
    must have one width that the number of parts divides; others fail the job. The codebooks
    start as the rows with the smallest ids (null ids last, ties by components), fewer than
    ``entries`` if there are fewer rows; without rows they are empty. Components beyond the
    range of 64-bit integers become the nearest such integer, and all arithmetic stays exact.
    Rows that repeat stay and count each time. Other columns are not read.

    ``code`` has a byte per part. Each round reads the rows and their codes, and writes them
    with new codes below the shared folder, so a lost executor repeats its tasks only.
    """
    params = params or BallKMeansParams()
    if not 1 <= params.entries <= 256:
        raise ValueError("a code of one byte tells 1 to 256 entries apart")
    usable = staged(_usable(vectors, vec_id, vector, label, params.scale), "vector_parts")
    books = first_codebooks(usable, params)
    if books is None:
        none = usable.withColumns({"code": F.lit(b""), "error": F.lit(0).cast("decimal(38,0)")})
        return Coded(none, np.empty((params.parts, 0, 0), dtype=object))
    width = books.shape[0] * books.shape[2]
    fits = F.when(F.size("v") == width, F.col("v")).otherwise(
        F.raise_error(F.concat(F.lit(f"a vector is not {width} wide: "), F.size("v").cast("string")))
    )
    state = usable.withColumn("v", fits)
    for _ in range(params.rounds):
        state = staged(_advance(state, books, params), "vector_codes")
        books = _replaced(books, state)
    coded = staged(_advance(state, books, params), "vector_codes").where("v is not null").drop("sums")
    return Coded(coded, books)


def described(coded: Coded) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every coded row.

    ``code`` has two hex digits a part; errors beyond the range of long are its largest value.
    """
    long = lambda x: F.least(x, F.lit(Decimal(_LARGEST))).cast("long")
    totals = coded.rows.groupBy("label").agg(F.sum("error").cast("decimal(38,0)").alias("total"))
    totals = totals.withColumnRenamed("label", "of_label")
    rows = coded.rows.join(totals, F.col("label").eqNullSafe(F.col("of_label")))
    return rows.select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        long(F.col("error")).alias("error"),
        long(F.col("total")).alias("label_error"),
        F.lit(coded.digest()).alias("codebooks_sha256"),
    )
