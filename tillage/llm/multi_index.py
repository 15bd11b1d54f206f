"""Hard negatives by an inverted multi-index.

Vectors are integers cut into two halves. Each half has its own codebook
(k-means on a bounded sample) and a pair of codes is a cell; every row is in
one. A codeword c with radius r (the largest distance of any row to it) bounds
an anchor's half score from above by ``<a, c> + |a| r`` and from below by
``<a, c> - |a| r``, and the sums of two halves bound every score in the cell.

An anchor visits cells in descending order of the upper bound, which the
multi-sequence heap over its two sorted lists of half bounds yields one by
one. It goes by rounds. The blocks of cells are dealt to shards of about
``SHARD_ROWS`` rows; a round ships a tile of anchors once to each shard that it
visits next, with the list of its visits, and a task scores them in matrix
products against the cells of its shard. A task holds one shard, one tile and
one product at a time, whatever the table's size. An anchor stops when its
result is certified: no cell not yet visited can hold a row that belongs to
it. First the positives are searched (the best rows of the same label), then
the windows of all positives of an anchor together (the best rows of other
labels whose scores lie between two shares of the positive's score). Results
are exact; the sample only affects how early the rounds stop.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillage.llm.tables import dropped, parts_for, recorded, released, written
from tillage.llm.topk import _products

SCALE = 256
SAMPLE = 20_000
STEPS = 8
ROWS_A_CELL = 256
MOST_CODES = 256
BLOCK = 4096
TILE = 512
SHARD_ROWS = 16_384
VISITS = 1 << 20
PRODUCTS = 1 << 20
TILE_BYTES = 8 << 20
FIRST_CELLS = 16
GROWTH = 4


def codebook(sample: np.ndarray, codes: int) -> np.ndarray:
    """k-means centres of the rows of ``sample`` (at most ``SAMPLE``), from evenly spaced rows of its first principal order."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centred = sample - sample.mean(0)
    axis = np.linalg.svd(centred, full_matrices=False)[2][0] if sample.shape[1] else np.zeros(0)
    order = np.argsort(centred @ axis, kind="stable")
    c = sample[order[np.linspace(0, len(sample) - 1, codes).astype(int)]].astype(np.float64)
    for _ in range(STEPS):
        near = nearest(sample, c)[0]
        n = np.bincount(near, minlength=codes)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre and its distance (infinite where it overflows)."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = (c * c).sum(1)[None, :] - 2 * (x @ c.T)
        code = d.argmin(1)
        return code, np.nan_to_num(np.sqrt(((x - c[code]) ** 2).sum(1)), nan=np.inf, posinf=np.inf)


def _matrix(vectors: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of a list column, shorter vectors filled with zeros."""
    off = vectors.offsets.to_numpy().astype(np.int64)
    flat = np.floor(scale * vectors.values.to_numpy(zero_copy_only=False).astype(np.float64))
    out, size = np.zeros((len(off) - 1, dim)), np.diff(off)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(off[:-1] - off[0], size)] = flat[off[0]:off[-1]]
    return out


def _pack(x: np.ndarray) -> bytes:
    return (x.astype(np.int32) if not x.size or np.abs(x).max() < 2 ** 31 else x).tobytes()


def _unpack(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.float64 if len(data) == 8 * rows * dim else np.int32).reshape(rows, dim)


class Index:
    """Codebooks of the halves, their radii and the rows of every cell: at most ``MOST_CODES`` codewords a half, whatever the table's size."""

    def __init__(self, dim: int, books: list[np.ndarray], radii: list[np.ndarray], rows: np.ndarray):
        self.dim, self.books, self.radii, self.rows = dim, books, radii, rows

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, :self.dim // 2], x[:, self.dim // 2:]]

    def bounds(self, a: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(upper, lower) bounds of the half scores of the vector ``a`` by codeword, wide enough for rounding."""
        upper, lower = [], []
        for half, book, radius in zip(self.halves(a[None, :]), self.books, self.radii):
            mid, reach = book @ half[0], np.linalg.norm(half[0]) * radius
            slack = 1 + 1e-9 * (np.abs(mid) + reach + np.abs(book) @ np.abs(half[0]))
            upper.append(np.nan_to_num(mid + reach + slack, nan=np.inf, posinf=np.inf))
            lower.append(np.nan_to_num(mid - reach - slack, nan=-np.inf, neginf=-np.inf))
        return upper, lower


def cells_by_bound(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Pairs of indices in descending order of ``first[i] + second[j]`` (multi-sequence heap)."""
    f, s = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap = [(-(first[f[0]] + second[s[0]]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(f[i]), int(s[j])
        if j + 1 < len(s):
            heapq.heappush(heap, (-(first[f[i]] + second[s[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(f):
            heapq.heappush(heap, (-(first[f[i + 1]] + second[s[0]]), i + 1, 0))


_TILES = ("shard int, kind int, cell int, cells binary, members binary, keys binary, ids binary, labels binary, data binary, "
          "low binary, high binary, ranges int")
_TILE_NAMES = [c.split()[0] for c in _TILES.split(", ")]


def _shards(rows: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, block, shard) of every block of the cells, which hold ``rows``: shards of as many rows each, give or take a block."""
    blocks = -(-rows // BLOCK)
    cell = np.repeat(np.arange(len(rows)), blocks)
    block = np.arange(len(cell)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = np.repeat(np.cumsum(rows) - rows, blocks) + block * rows[cell] // blocks[cell]
    return cell, block, first * shards // max(1, int(rows.sum()))


_STATE = ("data", "seen", "least", "most")


def _next_cells(ix: Index, data: bytes, seen: int, least: int | None, most: int | None, cells: int) -> Iterator[tuple[int, int]]:
    """An anchor's next cells, while its result is open: up to ``cells`` places of its order, those already seen left out.

    ``least``: a row below it belongs to no result any more (null: any row
    may); ``most``: a row above it belongs to none."""
    upper, lower = ix.bounds(_unpack(data, 1, ix.dim)[0].astype(np.float64))
    place = 0
    for bound, i, j in cells_by_bound(*upper):
        if place >= cells or least is not None and bound < least:
            return
        if ix.rows[i, j] and (place := place + 1) > seen and (most is None or lower[0][i] + lower[1][j] <= most):
            yield i, j


def _open_rows(shared, cells: int):
    """One row if any anchor has a next cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = False
        for b in batches:
            if not found and any(next(_next_cells(shared.value[0], *r, cells), None) for r in zip(*(b.column(c).to_pylist() for c in _STATE))):
                found = True
                yield pa.record_batch([pa.array([True])], names=["open"])
    return run


def _visit_rows(shared, cells: int):
    """Tiles of anchors with their next cells, a row for each shard that has some."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, off, shard_of = shared.value
        width = len(ix.books[1])
        tile = max(1, min(TILE, VISITS // cells))
        for b in (b.slice(at, tile) for b in batches for at in range(0, b.num_rows, tile)):
            member, visited = array("i"), array("i")
            for row, r in enumerate(zip(*(b.column(c).to_pylist() for c in _STATE))):
                for i, j in _next_cells(ix, *r, cells):
                    member.append(row)
                    visited.append(i * width + j)
            if len(visited):
                yield from _tiles(b, np.array(member, np.int32), np.array(visited, np.int32), off, shard_of, ix.dim)
    return run


def _tiles(b: pa.RecordBatch, member: np.ndarray, cell: np.ndarray, off: np.ndarray, shard_of: np.ndarray, dim: int) -> Iterator[pa.RecordBatch]:
    """A row for each shard: its cells and the members that visit them, ordered by cell, and these members' vectors and ranges."""
    size = (off[1:] - off[:-1])[cell]
    at = np.repeat(np.arange(len(cell)), size)
    shard = shard_of[np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + off[cell[at]]]
    order = np.lexsort((member[at], cell[at], shard))
    shard, cell, member = shard[order], cell[at[order]], member[at[order]]
    key, ids, label = (np.array(b.column(c).to_pylist(), np.int64) for c in ("key", "id", "label"))
    data = np.concatenate([_unpack(d, 1, dim) for d in b.column("data").to_pylist()])
    lows, highs = b.column("low").to_pylist(), b.column("high").to_pylist()
    ranges = max(map(len, lows))
    low, high = np.ones((len(key), ranges), np.int64), np.zeros((len(key), ranges), np.int64)  # what an anchor lacks is an empty range
    for i, (x, y) in enumerate(zip(lows, highs)):
        low[i, :len(x)], high[i, :len(y)] = x, y
    cut = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
    rows: list[tuple] = []
    held = 0
    for lo, hi in zip(cut[:-1], cut[1:]):
        own, place = np.unique(member[lo:hi], return_inverse=True)
        rows.append((int(shard[lo]), 1, None, cell[lo:hi].tobytes(), place.astype(np.int32).tobytes(), key[own].tobytes(), ids[own].tobytes(),
                     label[own].tobytes(), _pack(data[own]), low[own].tobytes(), high[own].tobytes(), ranges))
        held += sum(len(x) for x in rows[-1] if isinstance(x, bytes))
        if held > TILE_BYTES or hi == len(shard):
            kinds = [pa.int32()] * 3 + [pa.binary()] * 8 + [pa.int32()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=_TILE_NAMES)
            rows, held = [], 0


def _block_rows(most: int, dim: int):
    """One row per run of equal (cell, block) of at most ``most`` rows: ids, labels and vectors as arrays of bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def block():
            ids, label, data = zip(*rows)
            vectors = np.concatenate([_unpack(d, 1, dim) for d in data])
            return pa.record_batch([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), *[
                pa.array([x], pa.binary()) for x in (np.array(ids, np.int64).tobytes(), np.array(label, np.int64).tobytes(), _pack(vectors))]],
                names=["cell", "block", "ids", "labels", "data"])
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("cell", "block", "id", "label", "data"))):
                if r[:2] != now or len(rows) >= most:
                    if rows:
                        yield block()
                    now, rows = r[:2], []
                rows.append(r[2:])
        if rows:
            yield block()
    return run


def _best(found: list[tuple], k: int) -> list[tuple]:
    """Of (anchor, range, id, score) arrays the best ``k`` rows of each anchor and range: higher scores first, ties to the smaller id."""
    if not found:
        return []
    q, w, ids, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids, ~score, w, q))
    q, w = q[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (w[1:] != w[:-1])]))
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate([first, [len(q)]])))
    keep = place < k
    return [(q[keep], w[keep], ids[order][keep], score[order][keep])]


def _scored_rows(dim: int, same: bool, k: int):
    """For each anchor of a tile and each of its score ranges, the shard's best ``k`` rows of the same or of other labels in the range.

    A shard's blocks come before its tiles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for b in batches:
            for i in range(b.num_rows):
                shard, kind, cell, ranges = (b.column(c)[i].as_py() for c in ("shard", "kind", "cell", "ranges"))
                if shard != now:
                    now, held = shard, {}
                ids, labels = (np.frombuffer(b.column(c)[i].as_buffer(), np.int64) for c in ("ids", "labels"))
                data = _unpack(b.column("data")[i].as_buffer(), len(ids), dim)
                if kind == 0:
                    order = np.argsort(ids, kind="stable")  # copies: the batch is given back
                    held.setdefault(cell, []).append((ids[order], labels[order], data[order]))
                    continue
                cells, members = (np.frombuffer(b.column(c)[i].as_buffer(), np.int32) for c in ("cells", "members"))
                key, low, high = (np.frombuffer(b.column(c)[i].as_buffer(), np.int64) for c in ("keys", "low", "high"))
                found = _tile_best(held, cells, members, ids, labels, data, low.reshape(-1, ranges), high.reshape(-1, ranges), same, k)
                for q, w, vec, score in found:
                    yield pa.record_batch([pa.array(key[q]), pa.array(w.astype(np.int32)), pa.array(vec), pa.array(score)],
                                          names=["key", "w", "vec_id", "score"])
    return run


def _tile_best(held: dict, cells: np.ndarray, members: np.ndarray, ids: np.ndarray, labels: np.ndarray, data: np.ndarray,
               low: np.ndarray, high: np.ndarray, same: bool, k: int) -> list[tuple]:
    """The best ``k`` (anchor, range, id, score) of a tile's visits to the cells that ``held`` has."""
    some = low <= high
    least = np.where(some, low, np.iinfo(np.int64).max).min(axis=1)
    most = np.where(some, high, np.iinfo(np.int64).min).max(axis=1)
    found: list[tuple] = []
    size = 0
    cut = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]])
    for a, z in zip(cut[:-1], cut[1:]):
        for cid, clabel, vectors in held.get(int(cells[a]), ()):
            step = max(1, PRODUCTS // len(cid))
            for who in (members[at:min(z, at + step)] for at in range(a, z, step)):
                s = _products(data[who], vectors)
                q, c = np.nonzero((s >= least[who, None]) & (s <= most[who, None]))
                fits = (cid[c] != ids[who[q]]) & ((clabel[c] == labels[who[q]]) == same)
                q, c = q[fits], c[fits]
                s, q, c = s[q, c], who[q], cid[c]
                for w in range(low.shape[1]):
                    at = np.flatnonzero((s >= low[q, w]) & (s <= high[q, w]))
                    if len(at):
                        found.append((q[at], np.full(len(at), w), c[at], s[at]))
                        size += len(at)
                if size > PRODUCTS:
                    found = _best(found, k)
                    size = 0
    return _best(found, k)


def _usable(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    fine = F.forall(F.col("vector"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"), label.alias("label"))
            .where("id is not null and label is not null and vector is not null").where(fine))


def build_index(rows: DataFrame, scale: int, sample: int = SAMPLE, rows_a_cell: int = ROWS_A_CELL) -> tuple[Index, DataFrame]:
    """The index of ``rows`` (id, vector, label) and its table of blocks (cell, block, ids, labels, data)."""
    spark = rows.sparkSession
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    n, dim = stats.n, max(stats.dim or 0, 1)
    codes = max(1, min(MOST_CODES, int((n / rows_a_cell) ** 0.5)))
    chosen = rows.orderBy(F.xxhash64("id", "vector"), "id").limit(sample).select("vector").toArrow().column("vector").combine_chunks()
    drawn = _matrix(chosen.chunk(0) if isinstance(chosen, pa.ChunkedArray) else chosen, dim, scale)
    books = [codebook(x, min(codes, max(1, len(drawn)))) for x in (drawn[:, :dim // 2], drawn[:, dim // 2:])]
    made = spark.sparkContext.broadcast((books, dim))  # at most 2 * MOST_CODES half vectors
    width = len(books[1])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (one, two), size = made.value
        for b in batches:
            x = _matrix(b.column("vector"), size, scale)
            (i, di), (j, dj) = nearest(x[:, :size // 2], one), nearest(x[:, size // 2:], two)
            yield pa.record_batch([b.column("id"), b.column("label"), pa.array([_pack(v) for v in x], pa.binary()), pa.array(i * width + j, pa.int32()),
                                   pa.array(di), pa.array(dj)], names=["id", "label", "data", "cell", "d1", "d2"])

    coded = written(rows.mapInArrow(placed, "id long, label long, data binary, cell int, d1 double, d2 double"))
    counts, radii = np.zeros((len(books[0]), width), np.int64), [np.zeros(len(b)) for b in books]
    # One row per cell, at most MOST_CODES ** 2.
    for r in coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2")).collect():
        i, j = divmod(r.cell, width)
        counts[i, j] = r.n
        radii[0][i], radii[1][j] = max(radii[0][i], r.d1 * (1 + 1e-9)), max(radii[1][j], r.d2 * (1 + 1e-9))
    blocks = spark.createDataFrame([(int(c), int(-(-n // BLOCK))) for c, n in enumerate(counts.reshape(-1)) if n], "cell int, blocks int")
    dealt = (coded.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), "blocks").cast("int"))
             .select("cell", "block", "id", "label", "data"))
    parts = parts_for(spark, n, 50_000)
    made_blocks = written(dealt.repartition(parts, "cell", "block").sortWithinPartitions("cell", "block").mapInArrow(
        _block_rows(2 * BLOCK, dim), "cell int, block int, ids binary, labels binary, data binary"))
    return Index(dim, books, radii, counts), made_blocks


def _search(anchors: DataFrame, index: Index, blocks: DataFrame, same: bool, k: int) -> DataFrame:
    """(key, w, vec_id, score): the best ``k`` rows of each anchor's range w, by rounds over ever more cells.

    ``anchors``: key, id, label, data and the ranges ``low``, ``high``; empty ranges are left out of ``least`` and ``most``."""
    spark = anchors.sparkSession
    rows = index.rows.reshape(-1)
    n_cells, n_anchors, shards = int((rows > 0).sum()), anchors.count(), parts_for(spark, int(rows.sum()), SHARD_ROWS)
    cell, block, shard = _shards(rows, shards)
    in_shard = np.unique(cell * shards + shard)  # the shards of each cell, one after another
    shared = spark.sparkContext.broadcast((index, np.searchsorted(in_shard // shards, np.arange(len(rows) + 1)), in_shard % shards))
    places = spark.createDataFrame(list(zip(cell.tolist(), block.tolist(), shard.tolist())), "cell int, block int, shard int")
    missing = {c: F.lit(None).cast("binary") for c in ("cells", "members", "keys", "low", "high")}
    held = blocks.join(F.broadcast(places), ["cell", "block"]).withColumns(missing | {"kind": F.lit(0), "ranges": F.lit(0)}).select(*_TILE_NAMES)
    ranges = F.filter(F.arrays_zip("low", "high"), lambda r: r["low"] <= r["high"])
    state = (anchors.withColumn("ranges", ranges).where(F.size("ranges") > 0)
             .withColumn("least", F.array_min(F.col("ranges.low"))).withColumn("most", F.array_max(F.col("ranges.high"))).drop("ranges"))
    best = Window.partitionBy("key", "w").orderBy(F.col("score").desc(), "vec_id")
    found, seen, cells = None, 0, FIRST_CELLS
    while seen < n_cells:
        parts = parts_for(spark, n_anchors * min(cells, n_cells), VISITS)
        # By a hash of the key: dealt by the key itself, the join's few bytes would stay in a task or two.
        asked = state.withColumn("seen", F.lit(seen)).repartition(parts, F.xxhash64("key"))
        if not asked.mapInArrow(_open_rows(shared, cells), "open boolean").isEmpty():
            tiles = asked.mapInArrow(released(_visit_rows(shared, cells)), _TILES)
            dealt = held.unionByName(tiles).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind")
            scored = dealt.mapInArrow(released(_scored_rows(index.dim, same, k)), "key long, w int, vec_id long, score long")
            merged = scored if found is None else scored.unionByName(found)
            found = written(merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), free=True)
        seen, cells = cells, cells * GROWTH
        if found is not None:
            # A range with k rows is certified once no unseen cell reaches its worst row's score; until then that score is its floor.
            worst = found.groupBy("key", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst")).where(F.col("n") >= k)
            floors = worst.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w", "worst"))).alias("floors"))
            known = anchors.join(floors, "key", "left").withColumn("floors", F.coalesce("floors", F.create_map().cast("map<int,bigint>")))
            lows = F.transform("low", lambda x, w: F.greatest(x, F.coalesce(F.element_at("floors", w), x)))
            known = known.withColumn("low", lows).drop("floors")
            state = (known.withColumn("ranges", ranges).where(F.size("ranges") > 0)
                     .withColumn("least", F.array_min(F.col("ranges.low"))).withColumn("most", F.array_max(F.col("ranges.high"))).drop("ranges"))
    none = spark.createDataFrame([], "key long, w int, vec_id long, score long")
    return none if found is None else found


def hard_negatives(vectors: DataFrame, is_anchor: Column | None = None, label: Column | None = None, id_col: str = "vec_id",
                   vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3,
                   low_share: int = 50, high_share: int = 95, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    Anchors are the rows where ``is_anchor`` (a column over ``id`` and
    ``label``; default: id divisible by 50). An anchor's positives are its
    ``positives`` best other rows of the same label by integer inner product;
    a positive's negatives are the ``negatives`` best rows of other labels
    whose score is between ``low_share`` and ``high_share`` percent of the
    positive's. Ties go to the smaller id; components are floor(scale * x).
    ``label`` replaces the label column. Rows with a null id, label or vector,
    or with a null or non-finite component, take no part; other columns are
    ignored. A row with an anchor's own id is not its partner; a repeated
    candidate row counts each time, and a repeated anchor row is answered
    each time. Vectors of other lengths are compared over the components that
    both have. Anchors without positives, and positives without negatives,
    give no rows; nor does an empty table.
    """
    spark = vectors.sparkSession
    with recorded() as tables:
        rows = written(_usable(vectors, id_col, vector_col, (F.col(f"`{label_col}`") if label is None else label).cast("long")))
        index, blocks = build_index(rows, scale)
        blocks_at = tables[-1]
    dim = index.dim

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("vector"), dim, scale)
            yield pa.record_batch([b.column("key"), b.column("id"), b.column("label"), pa.array([_pack(v) for v in x], pa.binary())],
                                  names=["key", "id", "label", "data"])
    asked = rows.where(F.col("id") % 50 == 0 if is_anchor is None else is_anchor).withColumn("key", F.monotonically_increasing_id())
    anchors = written(asked.select("key", "id", "label", "vector").mapInArrow(packed, "key long, id long, label long, data binary"), free=True)
    dropped(spark, [t for t in tables if t != blocks_at])  # the blocks and the anchors hold all that is read from here on
    least, most = -(2 ** 63), 2 ** 63 - 1
    whole = anchors.withColumn("low", F.array(F.lit(least))).withColumn("high", F.array(F.lit(most)))
    top = _search(whole, index, blocks, True, positives)
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), "vec_id")
    pairs = written(top.select("key", (F.row_number().over(order) - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # low_share * p <= 100 * s <= high_share * p in whole numbers; a negative p leaves the range empty.
    p = F.col("positive_score").cast("decimal(38,0)")
    low, high = (-F.floor(-p * low_share / 100)).cast("long"), F.floor(p * high_share / 100).cast("long")
    windows = pairs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("w", low.alias("low"), high.alias("high")))).alias("all"))
    ranged = written(anchors.join(windows, "key").select("key", "id", "label", "data", F.col("all.low").alias("low"), F.col("all.high").alias("high")))
    hard = _search(ranged, index, blocks, False, negatives)
    rank = F.row_number().over(Window.partitionBy("key", "w").orderBy(F.col("score").desc(), "vec_id"))
    return (hard.withColumn("rank", rank).join(pairs, ["key", "w"]).join(anchors.select("key", "id"), "key")
            .select(F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
