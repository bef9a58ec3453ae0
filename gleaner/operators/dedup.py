"""Near-duplicate removal by cosine similarity, exact and without a cross join.

An item is dropped iff some *later* item is similar to it, "later" meaning larger in the
order columns with the id breaking ties. Similar means that the sum over models of the
cosines exceeds ``n_models * threshold``, compared as 32-bit floats.

For unit blocks the squared distance of two items is ``2 * (n_models - similarity)``, so
similar items lie within a fixed radius and the join is a metric range join:

1. Equal vectors are folded by a partially aggregated group-by; only the latest of them
   can survive. A group of copies of any size costs one row from here on.
2. Pivot vectors split the space into cells (nearest pivot). A row also visits a foreign
   cell when its distance to the bisecting plane between both pivots, and to the cell's
   outermost row, is within the radius; no similar pair can be missed.
3. In every cell a few of the latest rows act as witnesses. Rows similar to a later
   witness are settled: they are dropped and only serve as partners from then on. This
   takes dense groups of near-copies out of the quadratic part.
4. Cells are cut into tiles by a hash of the vector, at least about ``tile_rows`` rows each;
   one task compares one pair of tiles with a matrix product and emits dropped ids, never
   pairs. Two tiles of settled rows are not compared. A row goes to every tile that its own
   one meets, so tiles grow with the cells: what is moved follows the rows, not their square.

The number of pivots balances rows moved against products, estimated on a sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import to_list_array
from gleaner.session import staged

# Pivots and witnesses are broadcast: their number follows from this many bytes.
_BROADCAST_BYTES = 128 << 20
# The table of distances between pivots is square, hence a bound on their number too.
_MAX_PIVOTS = 2800
# How far the squared length of concatenated unit blocks may be off.
_UNIT_SLACK = 1e-3
# One side of a comparison task.
_TILE_BYTES = 64 << 20
_SMALLEST_TILE = 2048
# Tiles grow until rows are moved to comparisons this many times on average.
_MOVES_PER_ROW = 8
_WITNESSES_PER_CELL = 8
# Cells of a dense matrix a task may hold at a time.
_MATRIX_CELLS = 4 << 20
# Cells of a block of products; small enough to stay in a core's cache.
_BLOCK_CELLS = 1 << 19
_SAMPLE_ROWS = 2048
# Measured cost of moving one byte to a comparison, in multiplications.
_PRODUCTS_PER_BYTE = 40
# Slack for rounding in distances; it only widens the candidate set.
_SLACK = 1e-6


class _Layout:
    """Pivots, witnesses and tile counts as every task needs them (read only there)."""

    def __init__(self, pivots: np.ndarray, radius: float, limit: float, n_models: int = 1):
        self.pivots = pivots
        self.radius = radius
        self.limit = np.float32(limit)
        self.n_models = n_models
        self.cell_radius = np.full(len(pivots), np.inf)
        self.witness_vecs: dict[int, np.ndarray] = {}
        self.witness_keys: dict[int, list[tuple[tuple, tuple]]] = {}
        self.witness_sides: dict[int, list] = {}
        self.tiles: dict[int, tuple[int, int, int, int]] = {}
        self.gaps = np.sqrt(self.squared_distances(pivots))

    def squared_distances(self, x: np.ndarray) -> np.ndarray:
        squares = (x**2).sum(1)[:, None] + (self.pivots**2).sum(1)[None, :]
        return np.maximum(squares - 2 * x @ self.pivots.T, 0.0)

    def visits(self, d2: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Boolean matrix of the foreign cells every row has to visit.

        Cells a < b meet in a when a + b is even and in b otherwise, so that a pair of
        rows is compared once and the load is spread evenly.
        """
        own = d2[np.arange(len(d2)), home]
        gaps = self.gaps[home]
        cell = np.arange(len(self.pivots))[None, :]
        even = (cell + home[:, None]) % 2 == 0
        meets_there = np.where(cell < home[:, None], even, ~even) & (cell != home[:, None])
        reach = self.radius + _SLACK
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d2 - own[:, None]) / (2 * gaps)
        near = (gaps < 1e-9) | (plane <= reach)
        return near & (np.sqrt(d2) <= self.cell_radius[None, :] + reach) & meets_there

    def similar(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left @ right.T).astype(np.float32) > self.limit

    def similar_pairs(
        self, x: np.ndarray, left: np.ndarray, right: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Similar pairs of two sets of rows, block by block.

        A product in single precision, loosened by its largest possible error, finds the
        candidates; these are decided in double precision.
        """
        low = x.astype(np.float32)
        others = np.ascontiguousarray(low[right].T)
        error = np.float32((x.shape[1] + 4) * 2.0**-23 * self.n_models)
        step = max(1, _BLOCK_CELLS // max(1, len(right)))
        for start in range(0, len(left), step):
            part = left[start : start + step]
            near = low[part] @ others > self.limit - error
            n_near = np.count_nonzero(near)
            if not n_near:
                continue
            if n_near * 16 > near.size:
                i, j = np.nonzero(self.similar(x[part], x[right]))
                yield part[i], right[j]
            else:
                i, j = np.nonzero(near)
                i, j = part[i], right[j]
                exact = np.einsum("ij,ij->i", x[i], x[j]).astype(np.float32) > self.limit
                yield i[exact], j[exact]

    def settled(self, x: np.ndarray, home: np.ndarray, rows: _Rows) -> np.ndarray:
        """Rows similar to a later witness of their home cell (and of their group)."""
        settled = np.zeros(len(x), dtype=bool)
        for cell in np.unique(home):
            witnesses = self.witness_keys.get(cell)
            if not witnesses:
                continue
            members = np.flatnonzero(home == cell)
            hits = self.similar(x[members], self.witness_vecs[cell])
            close = members[hits.any(1)]
            sides = rows.sides(close)
            for k, (hit, (group, order)) in enumerate(zip(hits[hits.any(1)], rows.keys(close))):
                settled[close[k]] = any(
                    witnesses[w][0] == group
                    and witnesses[w][1] > order
                    and (sides is None or self.witness_sides[cell][w] != sides[k])
                    for w in np.flatnonzero(hit)
                )
        return settled


class _Columns:
    """The columns a comparison carries: group, order (id last) and their types.

    With a ``side``, only rows of different sides are compared.
    """

    def __init__(
        self,
        df: DataFrame,
        group: Sequence[str],
        order: Sequence[str],
        id_col: str,
        side: str | None = None,
    ):
        self.group = list(group)
        self.side = side
        self.order = list(dict.fromkeys([*order, id_col]))
        self.ids = list(dict.fromkeys([*group, id_col]))
        self.fold = list(dict.fromkeys([*group, *([side] if side else [])]))
        self.all = list(dict.fromkeys([*self.fold, *self.order]))
        self.types = dict(df.dtypes)

    def ddl(self, names: Sequence[str]) -> str:
        return ", ".join(f"`{n}` {self.types[n]}" for n in names)


def _matrix(vecs: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column of equally long vectors as a dense matrix."""
    if isinstance(vecs, pa.ChunkedArray):
        vecs = vecs.combine_chunks()
    flat = vecs.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vecs), -1)


def _packed_rows(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow binary column: shuffled as whole blocks of bytes."""
    n, row_bytes = len(x), x.shape[1] * x.itemsize
    offsets = pa.py_buffer((np.arange(n + 1) * row_bytes).astype(np.int32))
    data = pa.py_buffer(np.ascontiguousarray(x))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, data])


def _unpacked_rows(column: pa.ChunkedArray) -> np.ndarray:
    """Inverse of ``_packed_rows``."""
    rows = column.cast(pa.large_binary()).combine_chunks()
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.chunk(0)
    offsets = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
    data = np.frombuffer(rows.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(np.float64).reshape(len(rows), -1)


class _Rows:
    """A piece of an Arrow batch with its vectors."""

    def __init__(self, batch: pa.RecordBatch, columns: _Columns):
        self.batch = batch
        self.columns = columns
        self.x = _matrix(batch.column("vec"))

    def __len__(self) -> int:
        return self.batch.num_rows

    def vec_keys(self) -> np.ndarray:
        return self.batch.column("vec_key").to_numpy(zero_copy_only=False)

    def keys(self, at: np.ndarray) -> list[tuple[tuple, tuple]]:
        """``(group values, order values)`` of the rows at some positions."""
        part = self.batch.take(pa.array(at))

        def values(names: list[str]) -> list[tuple]:
            if not names:
                return [()] * len(at)
            return list(zip(*[part.column(n).to_pylist() for n in names]))

        return list(zip(values(self.columns.group), values(self.columns.order)))

    def sides(self, at: np.ndarray) -> list | None:
        """The sides of the rows at some positions, if sides are compared."""
        side = self.columns.side
        return None if side is None else self.batch.column(side).take(pa.array(at)).to_pylist()


def _located(
    batches: Iterable[pa.RecordBatch], layout: _Layout, columns: _Columns
) -> Iterator[tuple[_Rows, np.ndarray, np.ndarray]]:
    """Pieces of batches with squared pivot distances and home cells.

    Pieces are small enough for a matrix of rows x pivots.
    """
    step = max(1, _MATRIX_CELLS // max(layout.pivots.shape))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            rows = _Rows(batch.slice(start, step), columns)
            d2 = layout.squared_distances(rows.x)
            yield rows, d2, d2.argmin(1)


def _unit_blocks(vec: str, n_models: int) -> Column:
    """The vector, checked to have the length of ``n_models`` unit blocks."""
    squares = F.aggregate(vec, F.lit(0.0), lambda total, x: total + x * x)
    message = F.format_string(
        "a vector of squared length %f is not made of %d unit blocks", squares, F.lit(n_models)
    )
    wrong = F.col(vec).isNotNull() & (F.abs(squares - F.lit(float(n_models))) > _UNIT_SLACK)
    return F.when(wrong, F.raise_error(message).cast("array<double>")).otherwise(F.col(vec))


def _distinct_rows(df: DataFrame, vec: str, columns: _Columns) -> DataFrame:
    """The latest row of every distinct vector, with a hash of the vector as key.

    Partial aggregation before the shuffle folds copies however many there are. Rows
    without a vector are not folded: each is a group of its own.
    """
    message = F.lit("order columns of a near-duplicate search must not be null")
    latest = F.struct(
        *[F.coalesce(F.col(c), F.raise_error(message)).alias(c) for c in columns.order]
    )
    lone = F.when(F.col(vec).isNull(), F.col(columns.order[-1]))
    top = df.groupBy(
        *columns.fold,
        F.xxhash64(vec, lone).alias("vec_key"),
        F.col(vec).alias("vec"),
        lone.alias("lone"),
    ).agg(F.max(latest).alias("top"))
    carried = [F.col(f"top.{c}").alias(c) for c in columns.order if c not in columns.fold]
    return top.select(*columns.fold, "vec_key", "vec", *carried)


def survivors(
    df: DataFrame,
    id_col: str = "sample_id",
    vec: str = "vec",
    order: Sequence[str] = (),
    threshold: float = 0.99,
    n_models: int = 1,
    group: Sequence[str] = (),
    tile_rows: int | None = None,
    n_pivots: int | None = None,
) -> DataFrame:
    """Ids (with the group columns) of the items that stay.

    ``vec`` holds ``n_models`` concatenated unit blocks: a vector whose squared length is
    not their number fails the job. Items with a null vector always stay. Items are only
    compared within equal values of ``group``. ``tile_rows`` (the least size of a tile) and
    ``n_pivots`` follow from the data when not given and never change the result.
    """
    if not threshold > 0:
        raise ValueError("the similarity threshold must be above 0")
    columns = _Columns(df, group, order, id_col)
    limit = n_models * threshold
    if np.float32(n_models) <= np.float32(limit):
        return df.select(*columns.ids)

    # The one pass over the input; everything below reads what it wrote.
    distinct = staged(
        _distinct_rows(df.withColumn(vec, _unit_blocks(vec, n_models)), vec, columns),
        "distinct_vectors",
    )
    without = distinct.where(F.col("vec").isNull()).select(*columns.ids)
    rows = distinct.where(F.col("vec").isNotNull())
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    if size.n == 0:
        return without
    here, layout = _arranged(
        rows, columns, size.n, size.width, threshold, n_models, tile_rows, n_pivots
    )
    dropped = _dropped(here, layout, columns)
    kept = rows.select(*columns.ids).join(dropped, columns.ids, "left_anti")
    return kept.unionByName(without)


def _arranged(
    rows: DataFrame,
    columns: _Columns,
    n_rows: int,
    width: int,
    threshold: float,
    n_models: int,
    tile_rows: int | None,
    n_pivots: int | None,
) -> tuple[DataFrame, _Layout]:
    """Rows with their cell, visits and state, and the layout that tells where they meet."""
    limit = n_models * threshold
    row_bytes = 8 * width
    if tile_rows is None:
        share = n_rows // (4 * rows.sparkSession.sparkContext.defaultParallelism)
        tile_rows = min(max(1, _TILE_BYTES // row_bytes), max(_SMALLEST_TILE, share))
    pivots_given = n_pivots is not None
    if n_pivots is None:
        n_pivots = math.ceil(n_rows / _SMALLEST_TILE)
    budget = max(1, _BROADCAST_BYTES // (row_bytes * (1 + _WITNESSES_PER_CELL)))
    n_pivots = min(n_pivots, budget, _MAX_PIVOTS)

    radius = math.sqrt(max(0.0, 2 * (n_models - limit)) + _SLACK)
    # Smallest hashes first: a uniform sample of the distinct vectors, pivots in front.
    n_sample = min(_SAMPLE_ROWS, max(1, _TILE_BYTES // row_bytes))
    sample = rows.orderBy(F.xxhash64("vec_key"), "vec_key").limit(n_pivots + n_sample)
    points = np.array([r.vec for r in sample.select("vec").collect()])
    if not pivots_given:
        n_pivots = _pivot_count(points, n_pivots, radius, n_rows, tile_rows)
    layout = _Layout(points[:n_pivots], radius, limit, n_models)
    if n_rows <= tile_rows and len(layout.pivots) == 1:
        layout.tiles = {0: (1, 0, 0, 0)}
        here = rows.select(
            "*",
            F.lit(0).alias("home"),
            F.lit(False).alias("settled"),
            F.array().cast("array<int>").alias("visits"),
        )
    else:
        _choose_witnesses(rows, layout, columns)
        here = _settle(rows, layout, columns)
        _choose_tiles(here, layout, tile_rows)
    return here, layout


def _pivot_count(
    points: np.ndarray, most: int, radius: float, n_rows: int, tile_rows: int
) -> int:
    """The number of pivots, up to ``most``, with the least estimated work.

    More pivots mean smaller cells but more visits; which of the two wins depends on how
    clustered the vectors are, so both are measured on the sample.
    """
    rows = points[-_SAMPLE_ROWS:]
    candidates = sorted({*(4**i for i in range(12) if 4**i < most), most})
    best, least = 1, math.inf
    for n_pivots in candidates:
        layout = _Layout(points[:n_pivots], radius, 0.0)
        home, visits = np.zeros(n_pivots), np.zeros(n_pivots)
        step = max(1, _MATRIX_CELLS // n_pivots)
        for start in range(0, len(rows), step):
            d2 = layout.squared_distances(rows[start : start + step])
            nearest = d2.argmin(1)
            home += np.bincount(nearest, minlength=n_pivots)
            visits += layout.visits(d2, nearest).sum(0)
        home, visits = home * n_rows / len(rows), visits * n_rows / len(rows)
        home_tiles, visit_tiles = np.ceil(home / tile_rows), np.ceil(visits / tile_rows)
        width = points.shape[1]
        moved = home * (home_tiles + visit_tiles) + visits * home_tiles
        products = home * (home / 2 + visits) * width
        work = (moved * 8 * width * _PRODUCTS_PER_BYTE + products).sum()
        if work < least:
            best, least = n_pivots, work
    return best


def _share(rows: DataFrame, layout: _Layout) -> Broadcast:
    return rows.sparkSession.sparkContext.broadcast(layout)


def _choose_witnesses(rows: DataFrame, layout: _Layout, columns: _Columns) -> None:
    """Cell radii and, per cell and hash class, the latest row as a witness.

    Every task keeps one row per cell and class, so what reaches the driver is bounded by
    the pivot budget.
    """
    shared = _share(rows, layout)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = shared.value
        found: dict[tuple[int, int], tuple] = {}
        reach = np.zeros(len(here.pivots))
        for piece, d2, home in _located(batches, here, columns):
            np.maximum.at(reach, home, np.sqrt(d2[np.arange(len(d2)), home]))
            salts = piece.vec_keys() % _WITNESSES_PER_CELL
            # The latest row of every cell and class of this piece comes last.
            order = [(n, "ascending") for n in columns.order]
            by_order = pc.sort_indices(piece.batch, sort_keys=order).to_numpy()
            last = {(home[i], salts[i]): i for i in by_order}
            at = np.fromiter(last.values(), dtype=np.int64)
            sides = piece.sides(at) or [None] * len(at)
            for spot, i, key, side in zip(last, at, piece.keys(at), sides):
                if spot not in found or key[1] > found[spot][0][1]:
                    found[spot] = (key, piece.x[i].copy(), side)
        if found:
            names = [*columns.group, *columns.order]
            values = list(zip(*[(*key[0], *key[1]) for key, _, _ in found.values()]))
            if columns.side and columns.side not in names:
                names.append(columns.side)
                values.append(tuple(side for _, _, side in found.values()))
            homes = [int(h) for h, _ in found]
            data = {
                "home": pa.array(homes, pa.int32()),
                "salt": pa.array([int(s) for _, s in found], pa.int32()),
                "reach": pa.array(reach[homes]),
                "vec": to_list_array(np.stack([vec for _, vec, _ in found.values()])),
            }
            for name in columns.all:
                kind = piece.batch.schema.field(name).type
                data[name] = pa.array(values[names.index(name)], kind)
            yield pa.RecordBatch.from_pydict(data)

    partial = rows.mapInArrow(
        best, f"home int, salt int, reach double, vec array<double>, {columns.ddl(columns.all)}"
    )
    latest = F.struct(*columns.order)
    winners = partial.groupBy("home", "salt").agg(
        F.max("reach").alias("reach"),
        F.max_by(F.struct("vec", *columns.all), latest).alias("witness"),
    )
    by_cell: dict[int, list] = {}
    layout.cell_radius = np.zeros(len(layout.pivots))
    for row in winners.collect():
        layout.cell_radius[row.home] = max(layout.cell_radius[row.home], row.reach)
        by_cell.setdefault(row.home, []).append(row.witness)
    for cell, witnesses in by_cell.items():
        layout.witness_vecs[cell] = np.array([w["vec"] for w in witnesses])
        layout.witness_keys[cell] = [
            (tuple(w[n] for n in columns.group), tuple(w[n] for n in columns.order))
            for w in witnesses
        ]
        if columns.side:
            layout.witness_sides[cell] = [w[columns.side] for w in witnesses]
    shared.unpersist()


def _settle(rows: DataFrame, layout: _Layout, columns: _Columns) -> DataFrame:
    """Staged rows with their home cell, the cells they visit and whether they are settled.

    These follow from rounded products: they are decided once, and every later step reads
    the same answer.
    """
    shared = _share(rows, layout)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = shared.value
        for piece, d2, home in _located(batches, here, columns):
            row, cell = np.nonzero(here.visits(d2, home))
            sizes = np.bincount(row, minlength=len(piece))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            data = {n: piece.batch.column(n) for n in ["vec_key", "vec", *columns.all]}
            data["home"] = pa.array(home.astype(np.int32))
            data["settled"] = pa.array(here.settled(piece.x, home, piece))
            data["visits"] = pa.ListArray.from_arrays(offsets, pa.array(cell.astype(np.int32)))
            yield pa.RecordBatch.from_pydict(data)

    ddl = f"vec_key long, vec array<double>, {columns.ddl(columns.all)}"
    decided = rows.select("vec_key", "vec", *columns.all).mapInArrow(
        decide, f"{ddl}, home int, settled boolean, visits array<int>"
    )
    return staged(decided, "settled_vectors")


def _moves(sizes: Iterable[tuple[int, int, int, int]], tile_rows: int) -> int:
    """How many rows reach the comparisons of all cells when tiles have ``tile_rows`` rows."""
    moved = 0
    for counts in sizes:
        home_open, home_done, visit_open, visit_done = (math.ceil(n / tile_rows) for n in counts)
        n_home = home_open + home_done
        met = (n_home + visit_open + visit_done, home_open + visit_open, n_home, home_open)
        moved += sum(n * tiles for n, tiles in zip(counts, met))
    return moved


def _choose_tiles(rows: DataFrame, layout: _Layout, tile_rows: int) -> None:
    """Tile counts per cell: open and settled home rows, open and settled visitors.

    ``tile_rows`` is the least size: tiles double, up to what a task can hold, until rows are
    moved ``_MOVES_PER_ROW`` times on average.
    """
    at_home = rows.select(F.col("home").alias("cell"), F.lit(True).alias("is_home"), "settled")
    visiting = rows.select(F.explode("visits").alias("cell"), F.lit(False).alias("is_home"), "settled")
    sizes = {
        f"n{i}": F.count_if((F.col("is_home") == (i < 2)) & (F.col("settled") == (i % 2 == 1)))
        for i in range(4)
    }
    totals = (
        at_home.unionByName(visiting)
        .groupBy("cell")
        .agg(*[count.alias(n) for n, count in sizes.items()])
    )
    cells = {row.cell: tuple(row[n] for n in sizes) for row in totals.collect()}  # one row a cell
    most = max(tile_rows, _TILE_BYTES // (8 * layout.pivots.shape[1]))
    bound = _MOVES_PER_ROW * sum(map(sum, cells.values()))
    while tile_rows < most and _moves(cells.values(), tile_rows) > bound:
        tile_rows = min(2 * tile_rows, most)
    for cell, counts in cells.items():
        layout.tiles[cell] = tuple(math.ceil(n / tile_rows) for n in counts)


def _places(
    tiles: tuple[int, int, int, int],
    keys: np.ndarray,
    settled: np.ndarray,
    is_home: bool,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows, own tile, left tile, right tile)`` of rows that share a cell and a role.

    Tiles of a cell are numbered: open home, settled home, open visitors, settled
    visitors. Home tiles meet each other (once) and the visitors' tiles; settled tiles do
    not meet.
    """
    home_open, home_done, visit_open, visit_done = tiles
    n_home = home_open + home_done
    for done in (False, True):
        at = np.flatnonzero(settled == done)
        if not len(at):
            continue
        if is_home:
            first, n_own = (home_open, home_done) if done else (0, home_open)
        else:
            first, n_own = (n_home + visit_open, visit_done) if done else (n_home, visit_open)
        own = first + (keys[at] % np.uint64(n_own)).astype(np.int64)
        others = list(range(home_open if done else n_home))
        if is_home:
            others += range(n_home, n_home + visit_open + (0 if done else visit_done))
        for other in others:
            yield at, own, np.minimum(own, other), np.maximum(own, other)


def _dropped(rows: DataFrame, layout: _Layout, columns: _Columns) -> DataFrame:
    """Ids of the distinct rows that have a similar later row.

    With sides: ids of those that have a similar row of another side, with the place of the
    latest such row in the order as ``beaten_by`` (null for settled rows).
    """
    shared = _share(rows, layout)
    spots = ["cell", "left", "right", "tile"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = shared.value
        for batch in batches:
            piece = _Rows(batch, columns)
            settled = batch.column("settled").to_numpy(zero_copy_only=False)
            keys = piece.vec_keys().view(np.uint64) >> np.uint64(8)
            visits = batch.column("visits")
            visitor = np.repeat(np.arange(len(piece)), pc.list_value_length(visits).to_numpy())
            # Rows by cell and role: visitors first, then those at home.
            who = np.concatenate([visitor, np.arange(len(piece))])
            where = np.concatenate([visits.flatten().to_numpy(), batch.column("home").to_numpy()])
            spot = 2 * where.astype(np.int64) + (np.arange(len(who)) >= len(visitor))
            order = np.argsort(spot, kind="stable")
            who, spot = who[order], spot[order]
            ends = np.append(np.flatnonzero(spot[1:] != spot[:-1]) + 1, len(spot))
            parts: list[tuple[np.ndarray, ...]] = []
            for start, end in zip(np.append(0, ends[:-1]), ends):
                cell, is_home = divmod(int(spot[start]), 2)
                members = who[start:end]
                for at, own, left, right in _places(
                    here.tiles[cell], keys[members], settled[members], bool(is_home)
                ):
                    parts.append((members[at], np.full(len(at), cell), left, right, own))
            if not parts:
                continue
            source, *places = (np.concatenate(column) for column in zip(*parts))
            for start in range(0, len(source), len(piece)):
                part = slice(start, start + len(piece))
                chosen = source[part]
                taken = piece.batch.select(columns.all).take(pa.array(chosen))
                data = {n: taken.column(n) for n in columns.all}
                data["vec"] = _packed_rows(piece.x[chosen])
                for name, place in zip(spots, places):
                    data[name] = pa.array(place[part].astype(np.int32))
                data["is_open"] = pa.array(~settled[chosen])
                yield pa.RecordBatch.from_pydict(data)

    def compare(table: pa.Table) -> pa.Table:
        here = shared.value
        order = [(n, "ascending") for n in columns.order]
        ranks = np.empty(len(table), dtype=np.int64)
        ranks[pc.sort_indices(table, sort_keys=order).to_numpy()] = np.arange(len(table))
        tile = table.column("tile").to_numpy()
        left = np.flatnonzero(tile == table.column("left").to_numpy())
        right = np.flatnonzero(tile == table.column("right").to_numpy())
        x = _unpacked_rows(table.column("vec"))
        if columns.side:
            return latest_partners(table, x, ranks, left, right)
        drop = np.zeros(len(table), dtype=bool)
        for i, j in here.similar_pairs(x, left, right):
            drop[i[ranks[i] < ranks[j]]] = True
            drop[j[ranks[j] < ranks[i]]] = True
        drop &= table.column("is_open").to_numpy()
        return table.select(columns.ids).filter(pa.array(drop))

    def latest_partners(table, x, ranks, left, right) -> pa.Table:
        sides = table.column(columns.side).combine_chunks().dictionary_encode(null_encoding="encode")
        side = (sides if isinstance(sides, pa.DictionaryArray) else sides.chunk(0)).indices.to_numpy()
        best = np.full(len(table), -1)
        for one in np.unique(side[left]):
            own, others = left[side[left] == one], right[side[right] != one]
            for i, j in shared.value.similar_pairs(x, own, others):
                np.maximum.at(best, i, ranks[j])
                np.maximum.at(best, j, ranks[i])
        found = np.flatnonzero((best >= 0) & table.column("is_open").to_numpy())
        by_rank = np.argsort(ranks)
        here, partner = table.take(pa.array(found)), table.take(pa.array(by_rank[best[found]]))
        out = {n: here.column(n) for n in columns.ids}
        out |= {f"by_{k}": partner.column(n) for k, n in enumerate(columns.order)}
        return pa.table(out)

    spread = rows.mapInArrow(
        send,
        f"{columns.ddl(columns.all)}, vec binary, cell int, left int, right int, "
        "tile int, is_open boolean",
    )
    ids = columns.ddl(columns.ids)
    if columns.side:
        by = "".join(f", by_{k} {columns.types[n]}" for k, n in enumerate(columns.order))
        met = spread.groupBy(*columns.group, "cell", "left", "right").applyInArrow(compare, ids + by)
        latest = F.struct(*[F.col(f"by_{k}").alias(n) for k, n in enumerate(columns.order)])
        partners = met.groupBy(*columns.ids).agg(F.max(latest).alias("beaten_by"))
        settled = rows.where("settled").select(*columns.ids, F.lit(None).alias("beaten_by"))
        return partners.unionByName(settled)
    beaten = spread.groupBy(*columns.group, "cell", "left", "right").applyInArrow(compare, ids)
    beaten = beaten.unionByName(rows.where("settled").select(*columns.ids))
    return beaten.distinct()


def survivors_across(
    df: DataFrame,
    side: str,
    id_col: str = "sample_id",
    vec: str = "vec",
    order: Sequence[str] = (),
    threshold: float = 0.99,
    n_models: int = 1,
    group: Sequence[str] = (),
    tile_rows: int | None = None,
    n_pivots: int | None = None,
) -> DataFrame:
    """``(group columns, side, id)`` of the items without a later similar item of another side.

    A range join between sets instead of within one: items of the same ``side`` never drop
    each other, however alike they are, and an item that itself goes still beats others.
    Copies of a vector are folded on each side and share its latest partner; each is then
    judged by its own place in the order, which holds over all sides. An id may stand on
    several sides; on one side it must be unique. A null side is a side of its own. Items
    with a null vector always stay. The other parameters are those of ``survivors``.
    """
    if not threshold > 0:
        raise ValueError("the similarity threshold must be above 0")
    columns = _Columns(df, group, order, id_col, side)
    # An id on two sides is told apart by its side.
    columns.ids = list(dict.fromkeys([*columns.fold, id_col]))
    limit = n_models * threshold
    checked = df.withColumn(vec, _unit_blocks(vec, n_models))
    if np.float32(n_models) <= np.float32(limit):
        return df.select(*columns.ids)
    distinct = staged(_distinct_rows(checked, vec, columns), "distinct_vectors")
    rows = distinct.where(F.col("vec").isNotNull())
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    if size.n == 0:
        return df.select(*columns.ids)
    here, layout = _arranged(
        rows, columns, size.n, size.width, threshold, n_models, tile_rows, n_pivots
    )
    partners = _dropped(here, layout, columns)
    partners = partners.select(
        *[F.col(c).alias(f"with_{k}") for k, c in enumerate(columns.ids)], "beaten_by"
    )
    found = F.lit(True)
    for k, c in enumerate(columns.ids):
        found = found & F.col(c).eqNullSafe(F.col(f"with_{k}"))
    beaten = rows.join(partners, found).select(
        *[F.col(c).alias(f"of_{k}") for k, c in enumerate(columns.fold)],
        "vec_key",
        F.col("vec").alias("of_vec"),
        "beaten_by",
    )
    # Every copy of a folded vector meets its one row; settled rows have no partner named.
    place = F.struct(*columns.order)
    goes = F.col("beaten_by").isNull() | (place < F.col("beaten_by"))
    match = (F.xxhash64(vec) == F.col("vec_key")) & (F.col(vec) == F.col("of_vec"))
    for k, c in enumerate(columns.fold):
        match = match & F.col(c).eqNullSafe(F.col(f"of_{k}"))
    items = df.select(*columns.all, vec)
    return items.join(beaten, match & goes, "left_anti").select(*columns.ids)


def drop_near_duplicates(df: DataFrame, id_col: str = "sample_id", **search) -> DataFrame:
    """The rows of ``df`` that stay when later copies replace earlier ones.

    The order is the id alone unless ``order`` names columns; see ``survivors``.
    """
    keys = [*search.get("group", ()), id_col]
    return df.join(survivors(df, id_col=id_col, **search), keys, "left_semi")


def drop_worst_near_duplicates(
    df: DataFrame, score: str, id_col: str = "sample_id", **search
) -> DataFrame:
    """As ``drop_near_duplicates``, keeping the best-scored copy."""
    return drop_near_duplicates(df, id_col=id_col, order=[score], **search)


def dropped_items(df: DataFrame, id_col: str = "sample_id", **search) -> DataFrame:
    """Ids (with the group columns) of the items that go."""
    keys = [*search.get("group", ()), id_col]
    return df.select(*keys).join(survivors(df, id_col=id_col, **search), keys, "left_anti")


def remove_dropped(table: DataFrame, dropped: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """A table (items, features) without the dropped items."""
    return table.join(dropped.select(id_col), id_col, "left_anti")


def dedup_report(items: DataFrame, dropped: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """One row: items in total, items removed and their percentage."""
    flagged = items.select(id_col).join(
        dropped.select(id_col, F.lit(1).alias("gone")), id_col, "left"
    )
    total, gone = F.count("*"), F.count("gone")
    return flagged.agg(
        total.alias("total"),
        gone.alias("removed"),
        F.round(100 * gone.cast("double") / total, 1).alias("removed_percent"),
    )
