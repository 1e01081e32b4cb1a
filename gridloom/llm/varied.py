"""Choosing a varied subset: density from repeated locality-sensitive hash buckets, then a draw inversely weighted.

Each record gets TABLES sign codes of random hyperplanes, of as many bits as the count of records asks for, so that a bucket
holds about one record of no crowd at every size. The counts of its buckets, averaged over the tables, estimate how crowded it
is. The subset holds the records of smallest -ln(u) * density, a weighted sample without replacement of fixed size, after one
record of each category was taken. The key that parts the subset from the rest is found by histograms, so nothing is sorted
in one task.

Crowds (groups of near-identical records) are found with such a subset: it covers the variety of the data and holds few of any
crowd, so it gives the centres of cells, a pivot record for each, and by its weights how many rows a cell will hold. A record goes to its nearest centre's cell and
to every cell that one linked to it may be at home in: two linked records differ by a chord of known length at most, so one
that is farther than that from the plane between two centres has no link beyond it. No link is lost whatever the centres are.
A large cell is cut into parts, each compared with each; records linked to the cell's pivot are joined there and meet the others
only. Exact copies are joined beforehand by a hash of their vector, so a group of copies costs its size.

Rows with a null id or no usable vector are left out; records delivered twice count once; empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import vectors as V
from .graph import components
from .pairs import vectors_of, verified

TABLES, MAX_BITS = 6, 44
#: A code that more than this part of all entries share is heavy: there are at most as many heavy codes, and their counts are broadcast.
HEAVY_PART = 50_000
#: Ranges of a histogram, and rows beyond which the range of the cut is divided again.
BINS, FEW_ROWS = 1000, 10_000
#: Rows that a cell is planned for, and rows of the sample that centres and part numbers are taken from, at least.
CELL_ROWS, SAMPLE_ROWS = 2048, 20_000
#: A cell expected to hold more rows than this is cut into parts of about so many; every part meets every other.
PART_ROWS = 16_384


def planes(bits: int, seed: int = 31) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(V.DIM, TABLES * MAX_BITS)).reshape(V.DIM, TABLES, MAX_BITS)[:, :, :bits].reshape(V.DIM, -1).astype(np.float32)


def bits_for(rows: int) -> int:
    """Bits of a code, such that there are about as many codes as rows."""
    return int(min(MAX_BITS, max(6, np.ceil(np.log2(max(2, rows))))))


def codes_of(y: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(rows, TABLES) sign codes of unit vectors, the number of the table in front."""
    bits = p.shape[1] // TABLES
    weights, out = 1 << np.arange(bits, dtype=np.int64), np.empty((len(y), TABLES), np.int64)
    for lo in range(0, len(y), 4096):
        out[lo : lo + 4096] = (y[lo : lo + 4096] @ p > 0).reshape(-1, TABLES, bits) @ weights
    return out + (np.arange(TABLES, dtype=np.int64) << MAX_BITS)


def _coded(df: DataFrame, id_col: str, category_col: str | None, bits: int) -> DataFrame:
    """(id, category, codes) of the usable records."""
    p = planes(bits)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = V.dense(batch.column("embedding"))
            take = pa.array(rows)
            c = codes_of(V.unit(x) if len(x) else x, p)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * TABLES), pa.array(c.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).take(take), batch.column(1).take(take), lists], ["id", "category", "codes"])

    category = F.col(category_col).cast("string") if category_col else F.lit(None).cast("string")
    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), category.alias("category"), "embedding")
    return rows.mapInArrow(code, "id bigint, category string, codes array<bigint>")


def _hashed(df: DataFrame, id_col: str) -> DataFrame:
    """(id, h) of the usable records; h is a hash of the exact vector."""
    return df.filter(F.col(id_col).isNotNull() & V.is_usable()).select(F.col(id_col).cast("bigint").alias("id"), V.vector_hash().alias("h"))


def density(df: DataFrame, id_col: str, category_col: str | None, total: int | None = None) -> DataFrame:
    """(id, category, density): mean count of the record's buckets over the tables."""
    total = df.count() if total is None else total
    rows = _coded(df, id_col, category_col, bits_for(total)).groupBy("id").agg(F.min(F.struct("category", "codes")).alias("r"))
    rows = rows.select("id", "r.category", "r.codes")
    entries = rows.select("id", "category", F.explode("codes").alias("code"))
    counts = entries.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    bound = max(2, total * TABLES // HEAVY_PART)
    # the counts of heavy codes are broadcast, so that no task gets a crowd's entries; the others' are joined
    heavy = F.broadcast(counts.filter(F.col("n") > bound).select("code", F.col("n").alias("many")))
    marked = entries.join(heavy, "code", "left")
    key = F.when(F.col("many").isNull(), F.col("code")).otherwise(-F.col("id") - 1)  # a heavy one meets nothing in the join
    joined = marked.withColumn("key", key).join(counts.filter(F.col("n") <= bound).select(F.col("code").alias("key"), "n"), "key", "left")
    mean = F.sum(F.coalesce("many", "n", F.lit(1))) / F.lit(float(TABLES))
    return joined.groupBy("id").agg(F.min("category").alias("category"), F.round(mean, 6).alias("density"))


def cut(rows: DataFrame, key: str, size: int) -> tuple | None:
    """The (key, id) of the row that is number `size` in the order of key and id, or None if there are no more than `size` rows."""
    lo, hi, n = rows.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
    if n <= size:
        return None
    inside, need = rows, size
    while n > FEW_ROWS and lo < hi:
        bins = inside.groupBy(F.least(F.floor((F.col(key) - lo) / (hi - lo) * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n"))
        for b in sorted(bins.collect(), key=lambda b: b["bin"]):  # BINS rows at most
            if need <= b["n"]:
                break
            need -= b["n"]
        lo, hi, n = b["lo"], b["hi"], b["n"]
        inside = rows.filter(F.col(key).between(lo, hi))
    if n > FEW_ROWS and key != "id":  # equal keys: the ids decide
        return lo, (cut(inside, "id", need) or inside.agg(F.lit(0), F.max("id")).first())[1]
    last = inside.select(F.col(key).alias("k"), "id").orderBy("k", "id").limit(need).collect()[-1]  # FEW_ROWS rows at most
    return last["k"], last["id"]


def drawn(df: DataFrame, id_col: str, category_col: str | None, size: int, seed: int = 37) -> tuple[DataFrame, float | None]:
    """(id, category, density) of the varied subset, and the key that its records stay within (None: all records are in it)."""
    spark = df.sparkSession
    path = V.shared_dir(spark).rstrip("/") + "/density-" + uuid.uuid4().hex
    u = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    density(df, id_col, category_col).withColumn("key", -F.log(u) * F.col("density")).write.parquet(path)
    rows = spark.read.parquet(path)
    bound = cut(rows, "key", size)
    if bound is None:
        return rows.select("id", "category", "density"), None
    if category_col is None:
        return rows.filter((F.col("key") < bound[0]) | ((F.col("key") == bound[0]) & (F.col("id") <= bound[1]))).select("id", "category", "density"), bound[0]
    from .quota import canonical_udf

    spelled = rows.groupBy("category").agg(F.min_by(F.struct("id", "key"), F.struct("key", "id")).alias("best")).withColumn("c", canonical_udf("category"))
    first = spelled.filter(F.col("c").isNotNull()).groupBy("c").agg(F.min_by("best.id", F.struct("best.key", "best.id")).alias("id"))
    marked = rows.join(first.select("id", F.lit(0).alias("late")), "id", "left").withColumn("late", F.coalesce("late", F.lit(1)))
    early = marked.filter("late = 0")
    n = early.count()
    group, left = (1, size - n) if n < size else (0, size)
    bound = cut(marked.filter(F.col("late") == group), "key", left) if left else None
    within = F.lit(True) if bound is None and left else F.lit(False) if bound is None else (F.col("key") < bound[0]) | ((F.col("key") == bound[0]) & (F.col("id") <= bound[1]))
    chosen = marked.filter((F.col("late") < group) | ((F.col("late") == group) & within))
    return chosen.select("id", "category", "density"), bound[0] if bound else None


def subset(df: DataFrame, id_col: str, category_col: str | None, size: int, seed: int = 37) -> DataFrame:
    """(id, category, density): a varied subset of the given size, or all records if there are no more."""
    return drawn(df, id_col, category_col, size, seed)[0]


class Cells:
    """Centres of cells, for each a pivot (a record near the centre), and the numbers of its core and loose parts.

    All of it decides costs alone: whatever the centres, pivots and part numbers are, every linked pair meets or has a common pivot.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, total: int, floor: float, weight: np.ndarray | None = None):
        """weight is how many rows of the table each row of the sample stands for, alike for all if not given."""
        weight = np.full(len(x), total / max(1, len(x))) if weight is None else weight
        self.sure = floor + V.SLACK
        self.reach = (2 - 2 * floor) ** 0.5 + V.SLACK
        y = V.unit(x) if len(x) else x
        c = V.fit_cells(x, V.cells_for(total, CELL_ROWS))
        home, best = self._home(y, c)
        rows = np.bincount(home, minlength=len(c))
        # centres that split one tight group are one: its rows would visit all of them
        tight = np.bincount(home, best, len(c)) >= (2 * floor - 1) * np.maximum(rows, 1)
        i, j = np.nonzero(np.triu(c @ c.T >= 4 * floor - 3, 1) & tight[:, None] & tight)
        label = np.unique(V.join_labels(np.arange(len(c)), i, j), return_inverse=True)[1]
        sums = np.zeros((label.max() + 1, V.DIM))
        np.add.at(sums, label, c * np.maximum(rows, 1)[:, None])
        self.centres = (sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-12)).astype(np.float32)
        k = len(self.centres)
        self.cores, self.loose = np.zeros(k, np.int64), np.ones(k, np.int64)
        self.pivot_id, self.pivot = np.full(k, -1), np.zeros((k, V.DIM), np.float32)
        if not len(x):
            return
        home, best = self._home(y, self.centres)
        order = np.lexsort((ids, -best, home))
        first = order[np.flatnonzero(np.diff(home[order], prepend=-1))]
        self.pivot_id[home[first]], self.pivot[home[first]] = ids[first], y[first]
        r, to, _ = self.visits(y)
        core = (y[r] * self.pivot[to]).sum(1) >= self.sure
        parts = [np.ceil(np.bincount(to[m], weight[r[m]], minlength=k) / PART_ROWS).astype(np.int64) for m in (core, ~core)]
        hot = np.bincount(to, weight[r], minlength=k) > PART_ROWS
        self.cores, self.loose = np.where(hot, parts[0], 0), np.where(hot, np.maximum(parts[1], 1), 1)

    @staticmethod
    def _home(y: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = [y[lo : lo + 4096] @ c.T for lo in range(0, len(y), 4096)]
        return np.concatenate([t.argmax(1) for t in s] or [np.empty(0, np.int64)]), np.concatenate([t.max(1) for t in s] or [np.empty(0)])

    def visits(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, is home) for the cells that each unit row goes to. Of two cells that linked records are at home in, one is visited."""
        rows, cells, homes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
        at = np.arange(len(self.centres))
        for lo in range(0, len(y), 1024):
            s = y[lo : lo + 1024] @ self.centres.T
            home = s.argmax(1)
            apart = np.sqrt(np.maximum(2 - 2 * (self.centres[home] @ self.centres.T), 0) + 1e-6)
            near = s.max(1)[:, None] - s <= self.reach * apart + 1e-5
            near &= ((home[:, None] + at) % 2 == 0) == (at < home[:, None])
            near[np.arange(len(s)), home] = True
            r, c = np.nonzero(near)
            rows.append(r + lo)
            cells.append(c)
            homes.append(c == home[r])
        return np.concatenate(rows), np.concatenate(cells), np.concatenate(homes)

    def place(self, ids: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, task, side): a core part meets every loose part in a task, and a loose part every other and itself."""
        r, c, home = self.visits(y)
        core = self.cores[c] > 0
        core[core] = (y[r[core]] * self.pivot[c[core]]).sum(1) >= self.sure
        own = V.salt_of(ids[r], np.where(core, self.cores[c], self.loose[c]))
        times = np.where(core, 0, self.cores[c]) + self.loose[c]
        k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        r, c, home, core, own = (np.repeat(v, times) for v in (r, c, home, core, own))
        nc, nl = self.cores[c], self.loose[c]
        other = k - nc
        crossed, mixed = nc * nl + np.minimum(own, other) * nl + np.maximum(own, other), ~core & (k < nc)
        task = np.where(core, own * nl + k, np.where(mixed, k * nl + own, crossed))
        side = np.where(core, 0, np.where(mixed, 1, np.where(own == other, ~home, own > other)))
        return r, c, task, side

    def within(self, cell: int, task: int) -> bool:
        """Whether the first side of a task is compared with itself too."""
        nc, nl = int(self.cores[cell]), int(self.loose[cell])
        return task >= nc * nl and (task - nc * nl) // nl == (task - nc * nl) % nl

    def core_task(self, cell: int, task: int) -> bool:
        """Whether the first side of a task is a core part that no task before it had."""
        nc, nl = int(self.cores[cell]), int(self.loose[cell])
        return task < nc * nl and task % nl == 0


def _cells(df: DataFrame, id_col: str, category_col: str | None, floor: float) -> Cells:
    """Cells around a varied subset of the records, of a size that grows with the number of cells alone."""
    total = df.count()
    chosen, bound = drawn(df, id_col, category_col, max(SAMPLE_ROWS, V.PER_CELL * V.cells_for(total, CELL_ROWS)))
    table = vectors_of(df, id_col, True).join(F.broadcast(chosen.select("id", "density")), "id").toArrow()  # the subset's size bounds both
    ids, first = np.unique(np.asarray(table.column("id")), return_index=True)
    thick = np.asarray(table.column("density"))[first]
    # a record of density d is taken with the chance 1 - exp(-bound / d)
    weight = np.ones(len(ids)) if bound is None else 1 / np.maximum(-np.expm1(-bound / thick), 1e-9)
    return Cells(ids, V.unpack(table.column("vec"))[first], total, floor, weight)


def crowds(df: DataFrame, id_col: str, floor: float = 0.995, least: int = 8, category_col: str | None = None) -> DataFrame:
    """(group_id, id): groups of `least` or more records linked by a similarity of at least floor; group_id is the smallest id."""
    rows = _hashed(df, id_col)
    heads = rows.groupBy("h").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n"))
    same = rows.join(heads.filter("n > 1"), "h").filter("id != head").select(F.col("id").alias("u"), F.col("head").alias("v")).distinct()
    cells = _cells(df, id_col, category_col, floor)
    # one delivered twice is compared twice, to no effect
    vectors = vectors_of(df, id_col, False).join(heads.select(F.col("head").alias("id")), "id", "left_semi").select("id", "vec")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column("id"))
            r, c, task, side = cells.place(ids, V.unpack16(batch.column("vec")))
            for lo in range(0, len(r), 20_000):
                part = slice(lo, lo + 20_000)
                at = pa.array(r[part])
                yield pa.RecordBatch.from_arrays([pa.array(c[part].astype(np.int32)), pa.array(task[part]), pa.array(side[part].astype(np.int8)), batch.column("id").take(at), batch.column("vec").take(at)], ["cell", "task", "side", "id", "vec"])

    def bucket(ids: np.ndarray, y: np.ndarray, first: int, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (u, v, sure) of the first rows with the others, and among themselves if within: a forest of the links beyond doubt, and the pairs in doubt between its trees."""
        label = np.arange(len(ids))
        start = 0 if within else first
        open_a, open_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo, hi in V.tiles(first, len(ids)):
            sim = y[lo:hi] @ y[start:].T
            a, b = np.nonzero(sim >= floor - V.SLACK)
            up = a + lo < b + start
            a, b = a[up], b[up]
            sure = sim[a, b] >= floor + V.SLACK
            label = V.join_labels(label, lo + a[sure], start + b[sure])
            open_a.append(lo + a[~sure])
            open_b.append(start + b[~sure])
        a, b = np.concatenate(open_a), np.concatenate(open_b)
        apart = label[a] != label[b]
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, label, ids)
        keep = low[label] != ids
        u, v = np.concatenate([ids[keep], ids[a[apart]]]), np.concatenate([low[label][keep], ids[b[apart]]])
        return u, v, np.arange(len(u)) < keep.sum()

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        cell, task = key[0].as_py(), key[1].as_py()
        table = table.sort_by("side")
        ids, y = np.asarray(table.column("id")), V.unpack16(table.column("vec"))
        first = int((np.asarray(table.column("side")) == 0).sum())
        u, v, sure = bucket(ids, y, first, cells.within(cell, task))
        if cells.core_task(cell, task):
            u, v, sure = np.r_[u, ids[:first]], np.r_[v, np.full(first, cells.pivot_id[cell])], np.r_[sure, np.ones(first, bool)]
        rows = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v), sure]), axis=1)
        return pa.table({"u": rows[0], "v": rows[1], "sure": rows[2].astype(bool)})

    placed = vectors.mapInArrow(place, "cell int, task bigint, side tinyint, id bigint, vec binary")
    compared = placed.groupBy("cell", "task").applyInArrow(compare, "u bigint, v bigint, sure boolean")
    spark = df.sparkSession
    path = V.shared_dir(spark).rstrip("/") + "/varied-" + uuid.uuid4().hex
    compared.distinct().write.parquet(path)
    links = spark.read.parquet(path)
    edges = links.filter("sure").select("u", "v").unionByName(same)
    open_ = links.filter("not sure").select("u", "v")
    n = open_.count()
    if n:
        edges = edges.unionByName(verified(df, id_col, open_, n, floor))
    found = components(edges)
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return found.join(sizes, "root").select(F.col("root").alias("group_id"), F.col("id"))
