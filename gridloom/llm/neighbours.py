"""Most similar vectors for every vector: probed lists and an adaptive scan over blocks of rotated dimensions.

Lists are cells of spherical k-means fitted on a bounded sample (vectors.PER_CELL rows a cell); centres that split one dense
group are merged. Every row is indexed, in its best list and in every near-tied one, and two rows meet if they share a list.
Lists beyond vectors.PART_ROWS are cut into parts, and a task compares two parts. Inside a task vectors are rotated at random
and read in blocks of dimensions; after each block a pair is abandoned when its partial distance, scaled up, exceeds the bound
by more than the test allows. The bound is that of the row's k-th best so far, or the floor's. What is left is computed
exactly in double precision.

Exact copies: only the k + 1 smallest ids of a group of copies are searched; the others take over the neighbours of the first,
so a group of copies costs no more than its size. Nulls and unusable vectors have no neighbours.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import vectors as V

#: Width of a block of dimensions and the significance of the test, in standard deviations of the partial distance.
BLOCK, EPSILON = 16, 4.5
#: Rows that a list is planned for, and how much less than its best score a further list of a row may have.
LIST_ROWS, MARGIN = 192, 0.07


def rotation(dim: int, seed: int = 29) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


_ROTATION = rotation(V.DIM)


def _allowed(d: int, bound2: np.ndarray | float):
    """Largest partial squared distance over d dimensions that a pair within the bound may show."""
    return bound2 * d / V.DIM * (1 + EPSILON * np.sqrt(2.0 / d * (1 - d / V.DIM)))


#: Above this share of pairs left in a tile, the next block is multiplied for the whole tile; below, for the pairs left.
DENSE = 0.04
#: Rows and columns of a tile: its numbers fit a core's cache.
ROWS, COLUMNS = 256, 1024


def scan(z_a: np.ndarray, z_b: np.ndarray, own: np.ndarray, bound2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, similarity in single precision) of the pairs of rotated unit rows that no test abandoned.

    own is the number in b of each row of a, which is no pair, or less than 0. bound2 is the squared distance beyond which a row
    wants nothing. Partial distances grow block by block, and every block's test abandons pairs.
    """
    rest = bound2[:, None]
    part, d = None, 0
    while d < V.DIM:
        # one product gives |a|^2 - 2ab + |b|^2 of the block
        a, b = z_a[:, d : d + BLOCK], z_b[:, d : d + BLOCK]
        one_a, one_b = np.ones((len(a), 1), np.float32), np.ones((len(b), 1), np.float32)
        step = np.concatenate([a, (a * a).sum(1)[:, None], one_a], 1) @ np.concatenate([-2 * b, one_b, (b * b).sum(1)[:, None]], 1).T
        part = step if part is None else np.add(part, step, out=part)
        d += BLOCK
        left = part <= (_allowed(d, rest) if d < V.DIM else rest + 4e-6)
        if np.count_nonzero(left) <= DENSE * left.size:
            break
    has = np.flatnonzero(own >= 0)
    left[has, own[has]] = False
    i, j = np.nonzero(left)
    part = part[i, j]
    for d in range(d, V.DIM, BLOCK):
        gap = z_a[i, d : d + BLOCK] - z_b[j, d : d + BLOCK]
        part = part + (gap * gap).sum(1)
        keep = part <= (_allowed(d + BLOCK, bound2[i]) if d + BLOCK < V.DIM else bound2[i] + 4e-6)
        i, j, part = i[keep], j[keep], part[keep]
    return i, j, 1 - part / 2


def _places(i: np.ndarray) -> np.ndarray:
    """Place of each entry within its run of equal, sorted row numbers."""
    start = np.flatnonzero(np.diff(i, prepend=-1))
    return np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))


def search(ids: np.ndarray, x: np.ndarray, y: np.ndarray, queries: np.ndarray, among: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, other row, similarity) of the k nearest of each query row among the rows `among`; ties to the smaller id.

    queries and among are ranges of row numbers, the same one or apart.
    """
    z = y @ _ROTATION
    outs = []
    for lo in range(0, len(queries), ROWS):
        q = queries[lo : lo + ROWS]
        best = np.full((len(q), k), floor - 4e-6, np.float32)  # the k best so far, in single precision
        kept: list[tuple] = []
        for at in range(0, len(among), COLUMNS):
            part = among[at : at + COLUMNS]
            own = q - part[0]
            i, j, s = scan(z[q], z[part], np.where((own >= 0) & (own < len(part)), own, -1), 2 - 2 * best.min(1) + 8e-6)
            if not len(i):
                continue
            kept.append((i, part[j], s))
            order = np.lexsort((-s, i))
            place = _places(i[order])
            top = place < k
            new = np.full((len(q), k), -2, np.float32)
            new[i[order][top], place[top]] = s[order][top]
            best = -np.partition(-np.concatenate([best, new], 1), k - 1, axis=1)[:, :k]
        if not kept:
            continue
        i, j, s = (np.concatenate(c) for c in zip(*kept))
        near = s >= best.min(1)[i] - 8e-6  # less what rounding may hide
        i, j = i[near], j[near]
        exact = V.cosine(x[q[i]], x[j])
        good = exact >= floor
        i, j, exact = i[good], j[good], exact[good]
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        top = _places(i) < k
        outs.append((q[i[top]], j[top], exact[top]))
    if not outs:
        empty = np.empty(0, np.int64)
        return empty, empty, empty.astype(np.float64)
    return tuple(np.concatenate(p) for p in zip(*outs))


def copies(df: DataFrame, id_col: str, k: int) -> DataFrame:
    """(id, firsts): records beyond the k + 1 smallest ids of their group of exact copies, with the k smallest ids."""
    rows = df.filter(F.col(id_col).isNotNull() & V.is_usable()).select(F.col(id_col).cast("bigint").alias("id"), V.vector_hash().alias("h"))
    # a hot group is ranked in slices first: only the first of a slice can be among the first of all
    slices = rows.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(64))).groupBy("h", "slice").agg(F.collect_set("id").alias("ids"))
    slices = slices.select("h", F.slice(F.sort_array("ids"), 1, k + 2).alias("ids"))
    heads = slices.groupBy("h").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 2).alias("heads"))  # of 64 slices at most
    heads = heads.filter(F.size("heads") > k + 1)
    return rows.join(heads, "h").filter(F.col("id") > F.element_at("heads", k + 1)).select("id", F.slice("heads", 1, k).alias("firsts")).distinct()


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k nearest of each id. A pair that met in several lists has one place, so one exchange by the id serves the ranks and the removal of repeats."""
    return rows.withColumn("rank", F.dense_rank().over(W.partitionBy("id").orderBy(F.desc("similarity"), "other"))).filter(F.col("rank") <= k).distinct()


def nearest(df: DataFrame, id_col: str, k: int = 5, floor: float = 0.90) -> DataFrame:
    """(id, other, similarity, rank): the k most similar other records of every record, of a similarity of at least floor."""
    spark = df.sparkSession
    total = df.count()
    cells = V.cells_for(total, LIST_ROWS)
    sample = V.sample_vectors(df, id_col, V.PER_CELL * cells, total)
    centres = V.merge_close(V.fit_cells(sample, cells), sample, total)
    parts = V.parts_for(V.near_cells(V.unit(sample), centres, MARGIN)[1], len(centres), total / len(sample)) if len(sample) else np.ones(len(centres), np.int64)
    base = f"{V.shared_dir(spark).rstrip('/')}/nearest-{uuid.uuid4().hex}"
    copies(df, id_col, k).write.parquet(base + "/copies")
    beyond = spark.read.parquet(base + "/copies")
    has_copies = bool(beyond.limit(1).count())
    source = df.join(beyond.select(F.col("id").alias(id_col)), id_col, "left_anti") if has_copies else df

    def spread(ids, sides, x, y):
        r, c, _ = V.near_cells(y, centres, MARGIN)
        at, task, side = V.in_pairs(V.salt_of(ids[r], parts[c]).astype(np.int64), parts[c])
        return r[at], c[at], task, side

    def in_list(key: tuple, table: pa.Table) -> pa.Table:
        n = int(parts[key[0].as_py()])
        ids, sides, x, y = V.group_rows(table)
        every, cut = np.arange(len(ids)), int((sides == 0).sum())
        if key[1].as_py() % (n + 1) == 0:  # a part with itself
            runs = [(every, every)]
        else:
            runs = [(every[:cut], every[cut:]), (every[cut:], every[:cut])]
        found = [search(ids, x, y, a, b, k, floor) for a, b in runs if len(a) and len(b)]
        i, j, s = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"id": ids[i], "other": ids[j], "similarity": s})

    pairs = V.staged(source, id_col, spread).groupBy("cell", "task").applyInArrow(in_list, "id bigint, other bigint, similarity double")
    best = _ranked(pairs, k)
    if not has_copies:
        return best
    best.write.parquet(base + "/best")  # read twice below
    best = spark.read.parquet(base + "/best")
    # a copy is as similar to everything as the first of its group, so its nearest are among that one and that one's nearest
    heads = beyond.select("id", F.element_at("firsts", 1).alias("head"))
    near = heads.join(best.select(F.col("id").alias("head"), "other", "similarity"), "head").select("id", "other", "similarity")
    near = near.unionByName(heads.select("id", F.col("head").alias("other"), F.lit(1.0).alias("similarity")))
    return best.unionByName(_ranked(near, k))
