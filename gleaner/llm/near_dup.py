"""Near-duplicate grouping with SuperMinHash signatures, banding and union-find.

Every element of a set draws a random permutation of the signature's places, one place per
round, and offers the value ``round + uniform`` to it; a place keeps its smallest offer. The
ranks of one element differ from place to place, which lowers the variance against plain
MinHash, and a text stops as soon as every place has an offer from the rounds so far: most
texts need a few rounds, long ones a single one.

Signatures cut into bands give buckets of candidates. Candidates are linked only if their
full shingle sets are similar enough:

1. texts with the same set are folded into one representative, however many copies there are;
2. in every bucket each member is compared with a hub, another one for every bucket, and
   union-find groups the links;
3. members of a bucket that are still in different groups are compared in tiles of bounded
   size, which emit links only; a bucket's largest group is not compared with itself.

So a bucket with very many copies costs one comparison per member and not one per pair,
while every candidate pair either is compared or lies in one group already.
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
from gleaner.session import staged

_CHUNK = 1 << 15
#: Rows on either side of a tile.
_TILE = (128, 512)


@dataclass(frozen=True)
class NearDupParams:
    """``threshold_percent``: linked if 100 * intersection >= it * union.

    With 48 bands of 5 places a pair at exactly 80 percent is missed with probability
    ``(1 - 0.8**5)**48``, about 5e-9, and a closer pair far less often.
    """

    shingle: int = 5
    threshold_percent: int = 80
    bands: int = 48
    rows: int = 5
    bitmap_bits: int = 27


def shingle_sets(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted inside a text, with the sizes."""
    w = words.split(column, lower=True)
    h, firsts = w.hashes(), w.firsts()
    counts = np.diff(firsts)
    n = len(h)
    whole = h.copy()
    for k in range(1, shingle):
        shifted = np.zeros(n, dtype=np.uint64)
        shifted[: max(n - k, 0)] = h[k:]
        whole = words.mix64(whole * np.uint64(0x9E3779B97F4A7C15) + shifted)
    # The last places of a text start no full shingle; a short text is one shingle as a whole.
    position = np.arange(n) - firsts[w.text]
    left = counts[w.text] - position
    full = left >= shingle
    short = (counts[w.text] < shingle) & (position == 0)
    starts = np.zeros(n, dtype=bool)
    starts[full] = True
    at = np.flatnonzero((counts[w.text] < shingle) & (position == 0))
    if len(at):
        value = np.full(len(at), 0x51ED270B, dtype=np.uint64)
        size = counts[w.text[at]]
        for k in range(shingle - 1):
            more = size > k
            value[more] = words.mix64(value[more] * np.uint64(0x9E3779B97F4A7C15) + h[at[more] + k])
        whole[at] = value
        starts[at] = True
    values = whole[starts]
    ends = np.cumsum(np.bincount(w.text[starts], minlength=len(column)))
    keep = np.ones(len(values), dtype=bool)
    begin = 0
    for end in ends.tolist():
        if end > begin + 1:
            own = values[begin:end]
            own.sort()
            np.not_equal(own[1:], own[:-1], out=keep[begin + 1 : end])
        begin = end
    kept = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
    return values[keep], np.diff(kept)


def signatures(values: np.ndarray, sizes: np.ndarray, places: int) -> np.ndarray:
    """The SuperMinHash signature of each set: ``round << 32 | uniform`` per place."""
    out = np.full((len(sizes), places), np.iinfo(np.uint64).max, dtype=np.uint64)
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    row = 0
    while row < len(sizes):
        last = int(np.searchsorted(firsts, firsts[row] + _CHUNK, side="right")) - 1
        last = min(max(last, row + 1), len(sizes))
        _sign(values[firsts[row] : firsts[last]], sizes[row:last], out[row:last])
        row = last
    return out


def _sign(elements: np.ndarray, sizes: np.ndarray, out: np.ndarray) -> None:
    places = out.shape[1]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = None
    flat = out.reshape(-1)
    for step in range(places):
        if not len(elements):
            return
        salt = np.uint64((step + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        draw = words.mix64(elements + salt)
        low = draw & np.uint64(0xFFFFFFFF)
        pick = (step + ((low * np.uint64(places - step)) >> np.uint64(32))).astype(np.int64)
        if step == 0:
            place = pick
        else:
            # Swap the step's place with the picked one in each element's permutation.
            at = np.arange(len(elements))
            place = order[at, pick]
            order[at, pick] = order[at, step]
            order[at, step] = place
        offer = (np.uint64(step) << np.uint64(32)) | (draw >> np.uint64(32))
        np.minimum.at(flat, owner * places + place, offer)
        open_row = (out == np.iinfo(np.uint64).max).any(axis=1)
        if not open_row.any():
            return
        keep = open_row[owner]
        if step == 0:
            elements, owner, pick = elements[keep], owner[keep], pick[keep]
            order = np.tile(np.arange(places, dtype=np.int16), (len(elements), 1))
            at = np.arange(len(elements))
            order[at, pick] = 0
            order[at, 0] = pick
        elif not keep.all():
            elements, owner, order = elements[keep], owner[keep], order[keep]


def signed(
    docs: DataFrame, doc_id: str, text: str, params: NearDupParams, row: str | None = None
) -> DataFrame:
    """Staged (row, doc_id, n_shingles, set_digest, text_key, bands): one row per document.

    ``bands`` is empty for a document without words. The digest stands for the whole set.
    Rows are numbered here unless ``row`` names a column that does; then ``exact``, a hash of
    the unchanged text, is added.
    """
    exact = [F.xxhash64(text).alias("exact")] if row else []
    read = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        *exact,
    )
    places = params.bands * params.rows

    def compute(column: pa.Array) -> list:
        values, sizes = shingle_sets(column, params.shingle)
        signature = signatures(values, sizes, places).reshape(len(sizes), params.bands, params.rows)
        bands = np.zeros((len(sizes), params.bands), dtype=np.uint64)
        for k in range(params.rows):
            bands = words.mix64(bands * np.uint64(0x9E3779B97F4A7C15) + signature[:, :, k])
        bands = words.mix64(bands + np.arange(params.bands, dtype=np.uint64))
        some = sizes > 0
        return [
            pa.array(sizes, pa.int64()),
            pa.array(_digests(values, sizes), pa.binary()),
            _text_keys(column).view(np.int64),
            words.lists(bands[some].reshape(-1).view(np.int64), some * params.bands, pa.int64()),
        ]

    fields = {"n_shingles": "long", "set_digest": "binary", "text_key": "long", "bands": "array<long>"}
    return staged(words.with_columns(read, "text", fields, compute, keep=[c for c in read.columns if c != "text"]), "signed")


def _digests(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes)
    sets = [values[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)]
    return [hashlib.blake2b(r, digest_size=16).digest() for r in sets]


def _text_keys(column: pa.Array) -> np.ndarray:
    data, offsets = words.utf8(column)
    lowered = words.lower_bytes(data)
    keys = [
        hashlib.blake2b(lowered[a:b], digest_size=8).digest()
        for a, b in zip(offsets[:-1], offsets[1:], strict=True)
    ]
    return np.frombuffer(b"".join(keys), dtype=np.uint64)


def _sets(docs: DataFrame, text: str, wanted: DataFrame, params: NearDupParams) -> DataFrame:
    """Staged (rep, shingles) for the wanted (set_digest, rep, text_key).

    The bitmap of text keys only thins the scan; the join on the digest decides.
    """
    bitmap = bitmaps.collect_bitmap(wanted, F.col("text_key"), params.bitmap_bits)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    schema = pa.schema([("set_digest", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for part in words.slices(batches, "text"):
            keys = _text_keys(part.column("text"))
            found = np.flatnonzero(bitmaps.contains(shared.value, keys))
            fresh = [i for i in found.tolist() if keys[i] not in seen]
            if len(seen) < 1 << 16:
                seen.update(keys[fresh].tolist())
            values, sizes = shingle_sets(part.column("text").take(pa.array(fresh, pa.int64())), params.shingle)
            ends = np.cumsum(sizes)
            sets = [values[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)]
            digests = pa.array(_digests(values, sizes), pa.binary())
            yield words.record(schema, digests, pa.array(sets, pa.binary()))

    read = docs.select(F.col(text).alias("text"))
    found = read.mapInArrow(words.giving_back(run), "set_digest binary, shingles binary")
    exact = found.join(wanted.select("set_digest", "rep"), "set_digest").dropDuplicates(["rep"])
    sets = staged(exact.select("rep", "shingles"), "shingle-sets")
    shared.destroy()
    return sets


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of representatives whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("left_set"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("right_set"))
    both = pairs.join(left, "a").join(right, "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, dtype=bool)
            lefts, rights = batch.column("left_set"), batch.column("right_set")
            for i in range(batch.num_rows):
                x = np.frombuffer(lefts[i].as_buffer(), dtype=np.uint64)
                y = np.frombuffer(rights[i].as_buffer(), dtype=np.uint64)
                merged = np.concatenate([x, y])
                merged.sort(kind="stable")
                common = int(np.count_nonzero(merged[1:] == merged[:-1]))
                linked[i] = 100 * common >= percent * (len(merged) - common)
            keep = pa.array(linked)
            yield words.record(schema, batch.column("a").filter(keep), batch.column("b").filter(keep))

    return both.select("a", "b", "left_set", "right_set").mapInArrow(words.giving_back(run), "a long, b long")


def _local_forest(links: DataFrame) -> DataFrame:
    """Union-find inside each task: (node, root) with the smallest node as root.

    A task starts over after a million nodes, so its memory stays bounded.
    """
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent[root] != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        def forest() -> pa.RecordBatch:
            pairs = [(x, find(x)) for x in parent]
            pairs = [p for p in pairs if p[0] != p[1]]
            return words.record(schema, np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64))

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > 1 << 20:
                yield forest()
                parent.clear()
        yield forest()

    return links.mapInArrow(words.giving_back(run), "node long, root long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that is not itself a root.

    Union-find runs inside the tasks; what they disagree about is settled by rounds in which
    every root that is a node somewhere else takes over that one's root. Only rows of
    (node, root) move, and a node's rows are folded before they do.
    """
    edges = staged(_local_forest(links).distinct(), "forest")
    while True:
        # Each node points to its smallest root; its other roots point there too.
        least = edges.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("most"))
        pointed = staged(least, "least")
        others = (
            edges.join(pointed.where("least < most").select("node", "least"), "node")
            .where("root > least")
            .select(F.col("root").alias("node"), F.col("least").alias("root"))
        )
        # A root that points further is replaced by where it points.
        further = pointed.select(F.col("node").alias("root"), F.col("least").alias("next"))
        jumped = (
            pointed.select("node", F.col("least").alias("root"))
            .join(further, "root", "left")
            .select("node", F.coalesce("next", "root").alias("root"))
        )
        after = staged(_local_forest(jumped.unionByName(others)).distinct(), "forest")
        settled = (
            after.join(after.select(F.col("node").alias("root")).distinct(), "root", "left_semi").isEmpty()
            and after.groupBy("node").count().where("count > 1").isEmpty()
        )
        edges = after
        if settled:
            return edges


def _grouped(links: DataFrame, reps: DataFrame) -> DataFrame:
    """Staged (rep, component) for all representatives that stand in some bucket."""
    roots = components(links).select(F.col("node").alias("rep"), "root")
    return staged(
        reps.join(roots, "rep", "left").select("rep", F.coalesce("root", "rep").alias("component")),
        "components",
    )


def links_of(
    buckets: DataFrame, sets: DataFrame, reps: DataFrame, params: NearDupParams
) -> DataFrame:
    """Verified links (a, b) that connect whatever all similar candidate pairs connect.

    ``buckets`` has (bucket, rep, n): the members of every bucket with at least two;
    ``reps`` their (rep, bands).
    """
    percent = params.threshold_percent
    # Another hub for every bucket: the member with the smallest hash of both.
    lot = F.struct(F.xxhash64("bucket", "rep").alias("lot"), F.col("rep"), F.col("n"))
    hubs = buckets.groupBy("bucket").agg(F.min(lot).alias("hub"))
    alike = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent
    first = staged(
        buckets.join(hubs.select("bucket", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")), "bucket")
        .where((F.col("rep") != F.col("hub")) & alike)
        .select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
        .distinct(),
        "hub-pairs",
    )
    links = staged(_similar(first, sets, percent), "links")
    grouped = _grouped(links, reps)
    members = buckets.join(grouped, "rep")
    in_group = members.groupBy("bucket", "component").agg(F.count("*").alias("members"))
    largest = in_group.groupBy("bucket").agg(
        F.max(F.struct("members", "component")).alias("top"),
        F.count("*").alias("groups"),
        F.sum("members").alias("size"),
    )
    # The one pair of a bucket of two has been compared.
    mixed = staged(
        members.join(
            largest.where("groups > 1 and size > 2").select("bucket", F.col("top.component").alias("top")),
            "bucket",
        ).select("bucket", "rep", "component", (F.col("component") != F.col("top")).alias("outside")),
        "mixed-buckets",
    )
    return links.unionByName(staged(_tiled(mixed, sets, reps, params), "links"))


def _tiled(mixed: DataFrame, sets: DataFrame, reps: DataFrame, params: NearDupParams) -> DataFrame:
    """Links (a, b) between members of a bucket that the hubs left in different groups.

    A family is what buckets connect. Those outside the largest group of some bucket meet all
    members of their family in tiles of bounded size; nothing but links leaves a tile.
    """
    least = mixed.groupBy("bucket").agg(F.min("rep").alias("least"))
    edges = mixed.join(least, "bucket").where("rep > least").select("rep", "least").distinct()
    roots = components(edges).select(F.col("node").alias("rep"), F.col("root").alias("family"))
    member = (
        mixed.groupBy("rep")
        .agg(F.first("component").alias("component"), F.max("outside").alias("outside"))
        .join(roots, "rep", "left")
        .withColumn("family", F.coalesce("family", "rep"))
    )
    # Two bytes of a band's hash are enough to leave out pairs that share none.
    marks = F.transform("bands", lambda b: b.bitwiseAND(0x7FFF).cast("short")).alias("bands")
    member = staged(member.join(reps.select("rep", marks), "rep").join(sets, "rep"), "families")
    sizes = member.groupBy("family").agg(
        F.ceil(F.sum(F.col("outside").cast("long")) / _TILE[0]).cast("int").alias("n_left"),
        F.ceil(F.count("*") / _TILE[1]).cast("int").alias("n_right"),
    )
    placed = member.join(sizes, "family")
    lot = F.xxhash64("rep")
    row = ("rep", "component", "bands", "shingles")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.where("outside").select(
        "family", F.pmod(lot, "n_left").cast("int").alias("i"), every("n_right").alias("j"), F.lit(True).alias("is_left"), *row
    )
    right = placed.select(
        "family", every("n_left").alias("i"), F.pmod(lot, "n_right").cast("int").alias("j"), F.lit(False).alias("is_left"), *row
    )
    tiles = left.unionByName(right).repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    percent = params.threshold_percent

    def links(tile: list[dict]) -> list[tuple[int, int]]:
        lefts, rights = [r for r in tile if r["is_left"]], [r for r in tile if not r["is_left"]]
        if not lefts or not rights:
            return []
        bands = [np.array([r["bands"] for r in side], dtype=np.int16) for side in (lefts, rights)]
        component = [np.array([r["component"] for r in side]) for side in (lefts, rights)]
        own = [[np.frombuffer(r["shingles"], dtype=np.uint64) for r in side] for side in (lefts, rights)]
        size = np.array([len(x) for x in own[1]])
        flat, begins = np.concatenate(own[1]), np.concatenate([[0], np.cumsum(size)[:-1]])
        out = []
        for k, mine in enumerate(own[0]):
            meet = (bands[1] == bands[0][k]).any(axis=1) & (component[1] != component[0][k])
            meet &= 100 * np.minimum(size, len(mine)) >= percent * np.maximum(size, len(mine))
            if not meet.any():
                continue
            at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
            common = np.add.reduceat((mine[at] == flat).astype(np.int64), begins)
            meet &= 100 * common >= percent * (len(mine) + size - common)
            rep = lefts[k]["rep"]
            out.extend((min(rep, rights[m]["rep"]), max(rep, rights[m]["rep"])) for m in np.flatnonzero(meet))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["family"], r["i"], r["j"]) != key:
                    found = links(tile)
                    yield words.record(schema, [a for a, _ in found], [b for _, b in found])
                    key, tile = (r["family"], r["i"], r["j"]), []
                tile.append(r)
        found = links(tile)
        yield words.record(schema, [a for a, _ in found], [b for _, b in found])

    return tiles.mapInArrow(words.giving_back(run), "a long, b long").distinct()


def _shared_buckets(reps: DataFrame, params: NearDupParams) -> DataFrame:
    """(bucket, rep, n) for all buckets with at least two members.

    Most buckets have one: a bitmap of the others keeps their rows from being moved.
    """
    band = reps.select(F.explode("bands").alias("bucket"))
    shared = staged(band.groupBy("bucket").count().where("count > 1").select("bucket"), "shared")
    bitmap = bitmaps.collect_bitmap(shared, F.col("bucket"), params.bitmap_bits)
    broadcast = reps.sparkSession.sparkContext.broadcast(bitmap)
    schema = pa.schema([("bucket", pa.int64()), ("rep", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands = batch.column("bands")
            flat = bands.flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(bands.offsets.to_numpy()))
            keep = bitmaps.contains(broadcast.value, flat.view(np.uint64))
            owner = pa.array(owner[keep])
            yield words.record(schema, flat[keep], batch.column("rep").take(owner), batch.column("n").take(owner))

    found = reps.select("rep", "n", "bands").mapInArrow(words.giving_back(run), "bucket long, rep long, n long")
    return found.join(shared, "bucket", "left_semi")


def _members(
    docs: DataFrame, doc_id: str, text: str, params: NearDupParams, row: str | None = None
) -> DataFrame:
    """The rows of ``signed`` with ``component``: a row number, or below 0 without words."""
    rows = signed(docs, doc_id, text, params, row)
    filled = rows.where("n_shingles > 0")
    # Representatives of equal sets are row numbers; ids are looked up at the end.
    reps = staged(
        filled.groupBy("set_digest").agg(
            F.min("row").alias("rep"),
            F.first("n_shingles").alias("n"),
            F.first("text_key").alias("text_key"),
            F.first("bands").alias("bands"),
        ),
        "representatives",
    )
    buckets = staged(_shared_buckets(reps, params), "buckets")
    candidates = staged(buckets.select("rep").distinct(), "candidates")
    wanted = reps.join(candidates, "rep").select("set_digest", "rep", "text_key")
    sets = _sets(docs, text, wanted, params)
    links = links_of(buckets, sets, reps.join(candidates, "rep").select("rep", "bands"), params)
    grouped = _grouped(links, candidates).withColumnRenamed("component", "linked")
    classes = staged(
        reps.select("set_digest", "rep")
        .join(grouped, "rep", "left")
        .select("set_digest", F.coalesce("linked", "rep").alias("component")),
        "classes",
    )
    return rows.join(classes, "set_digest", "left").withColumn(
        "component", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(-1 - F.col("row"))
    )


def group(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    params: NearDupParams | None = None,
) -> DataFrame:
    """One row per document: row, doc_id, n_shingles, component_id, kept.

    Words are taken after lower-casing A-Z; a document with fewer words than a shingle has
    one shingle, one without words (or a null text) has none and is linked with nothing.
    ``component_id`` is the smallest id reachable over links. Rows that repeat an id are
    documents of their own that share it; of rows with the same id and set all carry the same
    result. A row with a null id keeps a null ``component_id`` if nothing in its group has an
    id; ``kept`` is true for the row whose id is the component's, and for null ids that stand
    alone. An empty table gives no rows; other columns of ``docs`` are not read.
    """
    member = _members(docs, doc_id, text, params or NearDupParams())
    least = member.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    same = F.col("doc_id") == F.col("component_id")
    return member.join(least, "component").select(
        "row",
        "doc_id",
        "n_shingles",
        "component_id",
        F.coalesce(same, F.col("doc_id").isNull() & F.col("component_id").isNull()).alias("kept"),
    )


def survivors(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: NearDupParams | None = None
) -> DataFrame:
    """One document of each group of near copies, with all columns of ``docs``.

    It is the row with the smallest id (a null id comes last), then the first in the table.
    Rows that repeat both its id and its text are the same document and stay with it; any
    other row of the group goes, whether it shares the id or has none. Rows are told apart by
    number, so a row stays or goes by its own text.
    """
    number = words.free_name(docs.columns, "row")
    numbered = words.numbered(docs, number)
    member = staged(
        _members(numbered, doc_id, text, params or NearDupParams(), number)
        .where("n_shingles > 0")
        .select("component", "doc_id", "row", "set_digest", "exact"),
        "members",
    )
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "set_digest", "exact")
    first = member.groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("size"))
    several = first.where("size > 1").select("component", "first")
    same = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("exact") == F.col("first.exact"))
    same = same & (F.col("set_digest") == F.col("first.set_digest"))
    stays = (F.col("row") == F.col("first.row")) | F.coalesce(same, F.lit(False))
    gone = member.join(several, "component").where(~stays).select(F.col("row").alias(number))
    return numbered.join(gone, number, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
