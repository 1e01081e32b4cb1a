"""Vectors of records: reading them in Arrow batches, coarse cells, and exact similarity inside a cell.

The vector of a record is its layers laid end to end. It is usable with LAYERS layers of WIDTH finite numbers that
are not all zero; rows without a usable vector yield nothing here. A record delivered several times is one record.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS, WIDTH = 4, 16
DIM = LAYERS * WIDTH
#: Rows that cells are fitted on: PER_CELL for each cell. A cell is planned for ROWS_PER_CELL rows; beyond FEW_CELLS their number grows with the root of the rows.
PER_CELL, FEW_CELLS, ROWS_PER_CELL = 12, 8192, 192
#: A record goes to its best cell and to every other whose score is within MARGIN of the best.
MARGIN = 0.07
#: A cell expected to hold more rows than this is cut into parts; tasks compare two parts at a time.
PART_ROWS = 32_768
ROWS_SCHEMA = "cell int, task bigint, id bigint, side tinyint, vec binary"
#: Similarities this near to a bound are computed again in double precision.
_NEAR = 2e-6


def dense(column: pa.Array, layers: int = LAYERS, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float32 matrix) of the usable vectors of an array<array<float>> column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    outer, inner = np.asarray(column.offsets), column.values
    lengths = np.diff(np.asarray(inner.offsets))
    lengths[~np.asarray(inner.is_valid())] = -1
    good = (np.diff(outer) == layers) & np.asarray(column.is_valid())
    rows = np.flatnonzero(good)
    if not len(rows):
        return rows, np.empty((0, layers * width), np.float32)
    whole = (lengths[outer[:n][rows][:, None] + np.arange(layers)] == width).all(1)
    rows = rows[whole]
    if not len(rows):
        return rows, np.empty((0, layers * width), np.float32)
    values = inner.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False) if not values.null_count else np.array(values.cast(pa.float32()).fill_null(float("nan")))
    starts = np.asarray(inner.offsets)[outer[:n][rows]]
    x = flat[starts[:, None] + np.arange(layers * width)]
    keep = np.isfinite(x).all(1) & x.any(1)
    return rows[keep], x[keep]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, as float32."""
    d = x.astype(np.float64)
    d /= np.abs(d).max(1, keepdims=True)  # no overflow or underflow of the squares
    return (d / np.sqrt((d * d).sum(1, keepdims=True))).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the rows of a with those of b, in double precision, rounded to 9 decimals."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    a /= np.abs(a).max(1, keepdims=True)
    b /= np.abs(b).max(1, keepdims=True)
    s = (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))
    return np.round(s, 9)


def unpack(column: pa.Array) -> np.ndarray:
    """Float32 rows of a binary column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, DIM), np.float32)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.float32, count=(offsets[-1] - offsets[0]) // 4, offset=int(offsets[0])).reshape(len(column), -1)


def pack(x: np.ndarray) -> pa.Array:
    """Binary column of float32 rows."""
    x = np.ascontiguousarray(x, np.float32)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(x.tobytes())])


#: Unit vectors may travel as 16-bit numbers; SLACK bounds what that changes of a similarity: 2 * sqrt(DIM) * half a step, and single precision.
_SCALE = 32767
SLACK = 2 * DIM**0.5 * 0.5 / _SCALE + 4e-6


def pack16(y: np.ndarray) -> pa.Array:
    q = np.round(y * _SCALE).astype(np.int16)
    offsets = np.arange(len(q) + 1, dtype=np.int32) * (q.shape[1] * 2)
    return pa.Array.from_buffers(pa.binary(), len(q), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(q.tobytes())])


def unpack16(column: pa.Array) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
    return np.frombuffer(c.buffers()[2], np.int16, count=(offsets[-1] - offsets[0]) // 2, offset=int(offsets[0])).reshape(len(c), -1).astype(np.float32) / _SCALE


def salt_of(ids: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """A salt below salts for each id, spread evenly."""
    h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (h % np.maximum(salts, 1).astype(np.uint64)).astype(np.int32)


def sample_vectors(df: DataFrame, id_col: str, at_most: int, total: int, seed: int = 17) -> np.ndarray:
    """Usable vectors of at most about at_most rows, chosen by a hash of the id, so alike wherever the rows lie."""
    part = 1.0 if total <= at_most else at_most / total
    chosen = df.filter(F.col(id_col).isNotNull())
    if part < 1.0:
        chosen = chosen.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1_000_000)) < int(part * 1_000_000))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = dense(batch.column(0))
            if len(x):
                yield pa.RecordBatch.from_arrays([pack(x)], ["vec"])

    table = chosen.select("embedding").mapInArrow(vectors, "vec binary").toArrow()
    return np.concatenate([unpack(c) for c in table.column(0).chunks] or [np.empty((0, DIM), np.float32)])[: 2 * at_most]


def cells_for(rows: int, per_cell: int = ROWS_PER_CELL) -> int:
    """Cells for a collection of so many rows; their centres are broadcast, 256 bytes each."""
    return int(max(4, min(rows // per_cell, max(FEW_CELLS, 2 * rows**0.5))))


def shares(y: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The best cell of each unit row."""
    return np.concatenate([(y[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(y), 4096)] or [np.empty(0, np.int64)])


def fit_cells(x: np.ndarray, cells: int, rounds: int = 5, seed: int = 3) -> np.ndarray:
    """Spherical k-means over a sample; empty cells are seeded again. Returns unit centres, at most one a sample row."""
    y = unit(x) if len(x) else np.zeros((1, DIM), np.float32)
    y = np.unique(y, axis=0)
    g = np.random.default_rng(seed)
    centres = y[g.permutation(len(y))[:cells]].copy()
    for _ in range(rounds):
        home = np.concatenate([(y[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(y), 4096)])
        sums = np.zeros_like(centres)
        order = np.argsort(home, kind="stable")
        first = np.flatnonzero(np.diff(home[order], prepend=-1))
        sums[home[order][first]] = np.add.reduceat(y[order], first, axis=0)
        norms = np.sqrt((sums * sums).sum(1))
        empty = norms < 1e-6
        sums[empty] = y[g.integers(0, len(y), int(empty.sum()))]
        centres = sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-12)
    return np.ascontiguousarray(centres, np.float32)


def merge_close(centres: np.ndarray, sample: np.ndarray, total: int, near: float = 0.9, most_rows: int = 1_000_000) -> np.ndarray:
    """Centres of which those that split one dense group are one again, while its cell is expected to hold most_rows at most.

    A group that a sample gives several centres would else lie in several cells, and near neighbours in different ones. The
    busiest centre takes the free ones around it, then the next busiest that is left: one vector of similarities at a time.
    """
    if len(centres) < 2 or not len(sample):
        return centres
    y = unit(sample)
    home = shares(y, centres)
    rows = np.bincount(home, minlength=len(centres)) * (total / len(y))
    sums = np.zeros(centres.shape)
    np.add.at(sums, home, y)
    owner = np.full(len(centres), -1)
    for k in np.argsort(-rows, kind="stable"):
        if owner[k] >= 0:
            continue
        owner[k] = k
        s = centres @ centres[k]
        free = np.flatnonzero((s >= near) & (owner < 0))
        free = free[np.argsort(-s[free], kind="stable")]
        owner[free[rows[k] + np.cumsum(rows[free]) <= most_rows]] = k
    kept, label = np.unique(owner, return_inverse=True)
    merged = np.zeros((len(kept), centres.shape[1]))
    np.add.at(merged, label, sums)
    norm = np.sqrt((merged**2).sum(1, keepdims=True))
    return np.ascontiguousarray(np.where(norm > 0, merged / np.maximum(norm, 1e-12), centres[kept]), np.float32)


def near_cells(y: np.ndarray, centres: np.ndarray, margin: float = MARGIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, is home) for the cells each unit row goes to: all of scores within margin of its best."""
    rows, cells, home = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
    for lo in range(0, len(y), 2048):
        s = y[lo : lo + 2048] @ centres.T
        first = s.argmax(1)
        r, c = np.nonzero(s >= (s.max(1) - margin)[:, None])
        rows.append(r + lo)
        cells.append(c)
        home.append(c == first[r])
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(home)


def parts_for(cells: np.ndarray, count: int, share: float, most: int | None = None) -> np.ndarray:
    """Parts of each cell: cells has those that the rows of a sample go to, share is how much of the table a sample row stands for."""
    return np.maximum(1, np.ceil(np.bincount(cells, minlength=count) * share / (most or PART_ROWS))).astype(np.int64)


def in_pairs(own: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, task, side): a row of part `own` of `parts` goes to the task of every pair of parts that has its own.

    The task of parts i <= j is i * parts + j; the rows of the smaller part are side 0, of the larger one side 1.
    """
    at = np.repeat(np.arange(len(own)), parts)
    other = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    mine = own[at]
    return at, np.minimum(mine, other) * parts[at] + np.maximum(mine, other), (mine > other).astype(np.int8)


def tiles(n: int, m: int, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of n rows such that a tile of rows by m columns has at most `most` cells."""
    step = max(16, min(n, most // max(1, m)))
    for lo in range(0, n, step):
        yield lo, min(n, lo + step)


def links(y_a: np.ndarray, y_b: np.ndarray, x_a: np.ndarray, x_b: np.ndarray, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (of a, of b) with a similarity of at least floor, tile by tile; exact near the bound."""
    for lo, hi in tiles(len(y_a), len(y_b)):
        s = y_a[lo:hi] @ y_b.T
        i, j = np.nonzero(s >= floor - _NEAR)
        near = np.flatnonzero(s[i, j] < floor + _NEAR)
        if len(near):
            ok = np.ones(len(i), bool)
            ok[near] = cosine(x_a[lo + i[near]], x_b[j[near]]) >= floor
            i, j = i[ok], j[ok]
        yield i + lo, j


def rough_links(y_a: np.ndarray, y_b: np.ndarray, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of short vectors that may be linked, tile by tile, and whether they are beyond doubt."""
    for lo, hi in tiles(len(y_a), len(y_b)):
        s = y_a[lo:hi] @ y_b.T
        i, j = np.nonzero(s >= floor - SLACK)
        yield i + lo, j, s[i, j] >= floor + SLACK


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the number of a row) after rows a[i] and b[i] came together; the smallest number stays."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
    return label


def staged(df: DataFrame, id_col: str, spread: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple], side: str | None = None, short: bool = False) -> DataFrame:
    """Rows (cell, task, id, side, vec) of the usable records. spread gets ids, sides, raw and unit vectors and returns row numbers, cells, tasks, sides.

    Of short rows vec is the unit vector in 16 bits, else the vector itself.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = dense(batch.column("embedding"))
            ids = batch.column(id_col).cast(pa.int64())
            known = np.asarray(ids.is_valid())[rows]
            rows, x = rows[known], x[known]
            if not len(rows):
                continue
            key = np.asarray(ids.fill_null(0))[rows]
            sides = np.asarray(batch.column("side").cast(pa.int8()).fill_null(0))[rows] if side else np.zeros(len(rows), np.int8)
            y = unit(x)
            r, c, t, sd = spread(key, sides, x, y)
            for lo in range(0, len(r), 20_000):
                part = slice(lo, lo + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(c[part].astype(np.int32)), pa.array(t[part].astype(np.int64)), pa.array(key[r[part]]), pa.array(sd[part].astype(np.int8)), pack16(y[r[part]]) if short else pack(x[r[part]])], ["cell", "task", "id", "side", "vec"])

    columns = [F.col(id_col), F.col("embedding")] + ([F.expr(side).cast("tinyint").alias("side")] if side else [])
    return df.select(*columns).mapInArrow(emit, ROWS_SCHEMA)


def group_rows(table: pa.Table, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, sides, raw vectors and unit vectors of a group, each id once, in order of side and id. Short rows have unit vectors alone."""
    ids = np.asarray(table.column("id").combine_chunks())
    sides = np.asarray(table.column("side").combine_chunks())
    order = np.lexsort((ids, sides))
    again = (ids[order][1:] == ids[order][:-1]) & (sides[order][1:] == sides[order][:-1])
    order = order[np.concatenate([np.ones(min(1, len(order)), bool), ~again])]
    x = np.concatenate([unpack16(c) if short else unpack(c) for c in table.column("vec").chunks] or [np.empty((0, DIM), np.float32)])[order]
    return ids[order], sides[order], x, unit(x) if len(x) and not short else x


def vector_hash(column: str = "embedding") -> F.Column:
    """A hash of the exact vector, in the engine: null layers and zeros of either sign count alike."""
    return F.xxhash64(F.transform(F.flatten(F.col(column)), lambda v: F.when(v == 0, F.lit(0.0).cast("float")).otherwise(v)))


def is_usable(column: str = "embedding") -> F.Column:
    """The rule of `dense`, as an expression."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    whole = F.forall(F.col(column), lambda r: (F.coalesce(F.size(r), F.lit(-1)) == WIDTH) & F.forall(r, finite))
    return F.coalesce((F.size(column) == LAYERS) & whole & F.exists(F.col(column), lambda r: F.exists(r, lambda v: v != 0)), F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; where none is set (tests), a folder of this machine becomes it."""
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not known:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        known = "file://" + tempfile.mkdtemp(prefix="gridloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(known)
    return known
