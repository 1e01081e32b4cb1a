"""Grouping records into similarity clusters: mergeable cluster-feature trees, Ward agglomeration, one assignment pass.

A cluster feature is (n, linear sum, exemplar): unit vectors make the square sum equal n. Trees grow per partition, their
leaves are summed up in a tree of merges whose size is bounded by the leaf limit, and the last merge's leaves are
agglomerated by Ward's criterion on the driver. Their number is planned from the count of rows and grows with its root.

Nulls: records without a usable vector or id belong to no cluster. Repeated records count once in links and sizes.
An empty table gives empty results.
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
from .graph import joined
from .pairs import verified

MIN_LEAVES = 256
#: Leaves never grow beyond this mean square radius by a raised bound; then the smallest join their nearest, if the union stays within
#: LOOSE_RADIUS2, or are set aside: records without a like. What is set aside has no say in the centres; its records are assigned like all others.
MAX_RADIUS2, LOOSE_RADIUS2 = 0.25, 0.5
#: Rows of the sample that parts of blocks are planned from.
SAMPLE_ROWS = 20_000
#: Leaves of one inner node of a tree, before the node is split.
NODE_LEAVES = 64
CF_SCHEMA = "pid int, n double, sums binary, ex_id bigint, ex_vec binary"


class CFTree:
    """Cluster-feature tree over unit vectors: an inner level of nodes and a level of leaves, filled in batches.

    A row descends to the nearest node and is absorbed by the node's nearest leaf if the leaf's mean square radius stays
    within `radius2`; else it becomes a leaf. Beyond the leaf limit the bound is raised, to MAX_RADIUS2 at most, and the leaves are
    entered anew; if that does not do, the smallest leaves join their nearest or are set aside, so crowded leaves stay tight.
    """

    def __init__(self, limit: int, radius2: float = 0.06):
        self.limit, self.radius2 = limit, radius2
        self.aside = 0.0  # rows of leaves that were set aside
        self._clear()

    def _clear(self) -> None:
        self.n, self.sums = np.zeros(0), np.zeros((0, V.DIM))
        self.ex_id, self.ex = np.zeros(0, np.int64), np.zeros((0, V.DIM), np.float32)
        self.node = np.zeros(0, np.int32)

    def _centres(self, n: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return (sums / n[:, None]).astype(np.float32)

    def add(self, n: np.ndarray, sums: np.ndarray, ex_id: np.ndarray, ex: np.ndarray) -> None:
        """Enter features (rows are features of n = 1)."""
        for lo in range(0, len(n), 1024):
            part = slice(lo, lo + 1024)
            self._enter(n[part], sums[part], ex_id[part], ex[part])
            while len(self.n) > self.limit:
                old = (self.n, self.sums, self.ex_id, self.ex)
                self.radius2 = min(MAX_RADIUS2, self.radius2 * 1.5)
                self._clear()
                for at in range(0, len(old[0]), 1024):
                    self._enter(*(x[at : at + 1024] for x in old))
                if self.radius2 >= MAX_RADIUS2 and len(self.n) > self.limit * 7 // 8:
                    self._squeeze()

    def _squeeze(self) -> None:
        """The smallest leaves join their nearest where both are alike, and are set aside elsewhere, until seven eighths of the limit are left."""
        keep = np.argsort(-self.n, kind="stable")[: max(1, self.limit * 7 // 8)]
        rest = np.setdiff1d(np.arange(len(self.n)), keep)
        to = (self._centres(self.n[rest], self.sums[rest]) @ self._centres(self.n[keep], self.sums[keep]).T).argmax(1)
        n, sums = self.n[keep].copy(), self.sums[keep].copy()
        total, union = n[to] + self.n[rest], sums[to] + self.sums[rest]
        alike = 1 - (union * union).sum(1) / (total * total) <= LOOSE_RADIUS2
        self.aside += self.n[rest][~alike].sum()
        np.add.at(n, to[alike], self.n[rest][alike])
        np.add.at(sums, to[alike], self.sums[rest][alike])
        self.n, self.sums, self.ex_id, self.ex, self.node = n, sums, self.ex_id[keep], self.ex[keep], np.zeros(len(n), np.int32)
        self._split(0)

    def _enter(self, n, sums, ex_id, ex) -> None:
        todo = np.arange(len(n))
        for _ in range(4):  # rows that made no leaf in one round may find one in the next
            if not len(todo):
                return
            todo = self._absorb(n, sums, todo)
            if not len(todo):
                return
            # of the rest, those that resemble no earlier one become leaves
            c = self._centres(n[todo], sums[todo])
            near = (c @ c.T) >= 1 - self.radius2
            near[np.triu_indices(len(c))] = False
            new = todo[~near.any(1)]
            self._append(n[new], sums[new], ex_id[new], ex[new])
            todo = np.setdiff1d(todo, new)
        if len(todo):
            self._append(n[todo], sums[todo], ex_id[todo], ex[todo])

    def _append(self, n, sums, ex_id, ex) -> None:
        if not len(self.n):
            node = np.zeros(len(n), np.int32)
        else:
            means = self._means()
            node = (self._centres(n, sums) @ means.T).argmax(1).astype(np.int32)
        self.n, self.sums = np.concatenate([self.n, n]), np.concatenate([self.sums, sums])
        self.ex_id, self.ex = np.concatenate([self.ex_id, ex_id]), np.concatenate([self.ex, ex])
        self.node = np.concatenate([self.node, node])
        for k in np.flatnonzero(np.bincount(self.node) > NODE_LEAVES):
            self._split(int(k))

    def _means(self) -> np.ndarray:
        nodes = int(self.node.max()) + 1
        m = np.zeros((nodes, V.DIM))
        np.add.at(m, self.node, self.sums)
        return (m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)).astype(np.float32)

    def _split(self, k: int) -> None:
        """Splits node k around two far leaves, again while it is too large."""
        own = np.flatnonzero(self.node == k)
        while len(own) > NODE_LEAVES:
            c = self._centres(self.n[own], self.sums[own])
            a = int((c @ c[0]).argmin())
            b = int((c @ c[a]).argmin())
            to_b = (c @ c[b]) > (c @ c[a])
            if not to_b.any() or to_b.all():
                to_b = np.arange(len(own)) % 2 == 1
            self.node[own[to_b]] = self.node.max() + 1
            other = own[to_b]
            own = own[~to_b]
            if len(other) > NODE_LEAVES:
                self._split(int(self.node[other[0]]))

    def _absorb(self, n, sums, todo) -> np.ndarray:
        if not len(self.n):
            return todo
        c = self._centres(n[todo], sums[todo])
        nodes = (c @ self._means().T).argmax(1)
        centres = self._centres(self.n, self.sums)
        leaf = np.empty(len(todo), np.int64)
        order = np.argsort(nodes, kind="stable")
        for block in np.split(order, np.flatnonzero(np.diff(nodes[order])) + 1):
            members = np.flatnonzero(self.node == nodes[block[0]])
            # nearest by squared distance of the centres
            m = centres[members]
            leaf[block] = members[((c[block] @ m.T) * 2 - (m * m).sum(1)).argmax(1)]
        total, merged = self.n[leaf] + n[todo], self.sums[leaf] + sums[todo]
        fits = 1 - (merged * merged).sum(1) / (total * total) <= self.radius2
        took = todo[fits]
        np.add.at(self.n, leaf[fits], n[took])
        np.add.at(self.sums, leaf[fits], sums[took])
        return todo[~fits]

    def refine(self, n, sums, rounds: int = 3) -> None:
        """Gives the features that came in to their nearest leaves anew, so that early leaves lose what later ones suit better."""
        c = self._centres(n, sums)
        c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
        for _ in range(rounds):
            m = self._centres(self.n, self.sums)
            m /= np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)
            to = np.concatenate([(c[i : i + 2048] @ m.T).argmax(1) for i in range(0, len(c), 2048)])
            count, total = np.zeros(len(m)), np.zeros((len(m), V.DIM))
            np.add.at(count, to, n)
            np.add.at(total, to, sums)
            full = count > 0
            self.n, self.sums, self.ex_id, self.ex, self.node = count[full], total[full], self.ex_id[full], self.ex[full], self.node[full]

    def batch(self, pid: int) -> pa.RecordBatch:
        k = len(self.n)
        return pa.RecordBatch.from_arrays([pa.array(np.full(k, pid, np.int32)), pa.array(self.n), V.pack(self.sums) if k else pa.array([], pa.binary()), pa.array(self.ex_id), V.pack(self.ex) if k else pa.array([], pa.binary())], ["pid", "n", "sums", "ex_id", "ex_vec"])


def leaf_limit(rows: int) -> int:
    return int(max(MIN_LEAVES, min(rows // V.ROWS_PER_CELL, 4 * rows**0.5)))


def leaves(df: DataFrame, id_col: str, limit: int, fan_in: int = 8) -> pa.Table:
    """Leaf summaries of the whole table, at most `limit` of them: trees per partition, merged fan_in at a time."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tree = CFTree(limit)
        for batch in batches:
            rows, x = V.dense(batch.column("embedding"))
            ids = batch.column(id_col).cast(pa.int64())
            ok = np.asarray(ids.is_valid())[rows]
            rows, x = rows[ok], x[ok]
            if len(rows):
                y = V.unit(x)
                tree.add(np.ones(len(rows)), y.astype(np.float64), np.asarray(ids.fill_null(0))[rows], x)
        yield tree.batch(TaskContext.get().partitionId())

    def merge(table: pa.Table) -> pa.Table:
        tree = CFTree(limit)
        pid = table.column("pid")[0].as_py()
        table = table.sort_by([("n", "descending"), ("ex_id", "ascending")])
        sums = np.concatenate([V.unpack(c) for c in table.column("sums").chunks]).astype(np.float64)
        ex = np.concatenate([V.unpack(c) for c in table.column("ex_vec").chunks])
        n = np.asarray(table.column("n"))
        tree.add(n, sums, np.asarray(table.column("ex_id")), ex)
        tree.refine(n, sums)
        return pa.Table.from_batches([tree.batch(pid)])

    scan = df.select(id_col, "embedding")
    parts = scan.rdd.getNumPartitions()
    level = scan.mapInArrow(grow, CF_SCHEMA)
    while parts > 1:
        parts = -(-parts // fan_in)
        level = level.withColumn("pid", (F.col("pid") / fan_in).cast("int")).groupBy("pid").applyInArrow(merge, CF_SCHEMA)
    return level.toArrow()


def ward(n: np.ndarray, sums: np.ndarray, radius2: float) -> np.ndarray:
    """Ward agglomeration of cluster features; two merge only while the mean square radius of the union is at most radius2.

    Returns the cluster of each leaf, clusters numbered from 0. Quadratic in the leaves, which are bounded.
    """
    k = len(n)
    n, sums = n.astype(np.float64).copy(), sums.astype(np.float64).copy()
    label = np.arange(k)
    if k < 2:
        return label
    c = sums / n[:, None]
    sq = (c * c).sum(1)

    def costs(i: int, alive: np.ndarray) -> np.ndarray:
        dot, total = c @ c[i], n + n[i]
        cost = n * n[i] / total * np.maximum(sq[i] + sq - 2 * dot, 0)
        # squared length of the union's mean
        merged = (n * n * sq + n[i] * n[i] * sq[i] + 2 * n * n[i] * dot) / (total * total)
        cost[(1 - merged > radius2) | ~alive] = np.inf
        cost[i] = np.inf
        return cost

    alive = np.ones(k, bool)
    best, to = np.empty(k), np.empty(k, np.int64)
    for i in range(k):
        row = costs(i, alive)
        to[i] = row.argmin()
        best[i] = row[to[i]]
    while True:
        i = int(np.where(alive, best, np.inf).argmin())
        if not np.isfinite(best[i]) or not alive[i]:
            break
        j = int(to[i])
        if not alive[j]:
            row = costs(i, alive)
            to[i] = row.argmin()
            best[i] = row[to[i]]
            continue
        alive[j] = False
        label[label == j] = i
        sums[i] += sums[j]
        n[i] += n[j]
        c[i] = sums[i] / n[i]
        sq[i] = (c[i] * c[i]).sum()
        for r in {i, *np.flatnonzero(alive & ((to == i) | (to == j))).tolist()}:
            row = costs(r, alive)
            to[r] = row.argmin()
            best[r] = row[to[r]]
        row = costs(i, alive)  # others may now be nearer to the union
        nearer = alive & (row < best)
        best[nearer], to[nearer] = row[nearer], i
    return np.unique(label, return_inverse=True)[1]


class Model:
    """Cluster centres (unit), sizes by the trees, and for each an exemplar record near its centre."""

    def __init__(self, table: pa.Table, radius2: float):
        k = table.num_rows
        table = table.sort_by([("n", "descending"), ("ex_id", "ascending")])
        if not k:
            self.centres, self.size, self.ex_id, self.ex = np.zeros((1, V.DIM), np.float32), np.zeros(1), np.full(1, -1), np.zeros((1, V.DIM), np.float32)
            return
        n = np.asarray(table.column("n"))
        sums = np.concatenate([V.unpack(c) for c in table.column("sums").chunks]).astype(np.float64)
        ex = np.concatenate([V.unpack(c) for c in table.column("ex_vec").chunks])
        ex_id = np.asarray(table.column("ex_id"))
        label = ward(n, sums, radius2)
        total = np.zeros((label.max() + 1, V.DIM))
        np.add.at(total, label, sums)
        self.size = np.bincount(label, weights=n)
        self.centres = (total / np.maximum(np.sqrt((total * total).sum(1, keepdims=True)), 1e-12)).astype(np.float32)
        near = (V.unit(ex) * self.centres[label]).sum(1)
        order = np.lexsort((ex_id, -near, label))
        first = order[np.flatnonzero(np.diff(label[order], prepend=-1))]
        self.ex_id, self.ex = ex_id[first], ex[first]


def fit(df: DataFrame, id_col: str, radius2: float = 0.1) -> Model:
    """Trees, merged leaves and their agglomeration, of all records."""
    return Model(leaves(df, id_col, leaf_limit(df.count())), radius2)


def describe(df: DataFrame, id_col: str, label_col: str, typical: int = 3, radius2: float = 0.1) -> DataFrame:
    """One row a cluster: cluster, size, labels (count of known ones), top_label, typical_1.. ids nearest the centre, mean_similarity.

    Every usable record is assigned to its nearest centre. Labels are compared trimmed and in lower case; ties go to the
    smaller label and the smaller id. Records delivered twice count once.
    """
    model = fit(df, id_col, radius2)
    centres = model.centres

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = V.dense(batch.column("embedding"))
            y = V.unit(x) if len(x) else x
            for lo in range(0, len(rows), 4096):
                s = y[lo : lo + 4096] @ centres.T
                at = rows[lo : lo + 4096]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(s.argmax(1).astype(np.int32)), pa.array(np.round(s.max(1).astype(np.float64), 6))], ["id", "label", "cluster", "similarity"])

    key = F.col(id_col).cast("bigint").alias("id")
    label = F.regexp_replace(F.lower(F.trim(F.col(label_col).cast("string"))), "_", " ").alias("label")
    rows = df.filter(F.col(id_col).isNotNull()).select(key, label, "embedding").mapInArrow(assign, "id bigint, label string, cluster int, similarity double")
    rows = rows.groupBy("id").agg(F.min("label").alias("label"), F.min("cluster").alias("cluster"), F.max("similarity").alias("similarity"))
    rank = W.partitionBy("cluster").orderBy(F.desc("similarity"), "id")
    members = rows.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= typical)
    nearest = members.groupBy("cluster").agg(*[F.max(F.when(F.col("rank") == k, F.col("id"))).alias(f"typical_{k}") for k in range(1, typical + 1)])
    labels = rows.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("similarity").alias("s"))
    heads = labels.groupBy("cluster").agg(F.sum("n").alias("size"), F.count("label").alias("labels"), F.max_by("label", F.struct(F.when(F.col("label").isNull(), -1).otherwise(F.col("n")))).alias("top_label"), F.round(F.sum("s") / F.sum("n"), 4).alias("mean_similarity"))
    return heads.join(nearest, "cluster").select("cluster", "size", "labels", "top_label", *[f"typical_{k}" for k in range(1, typical + 1)], "mean_similarity")


def linked(df: DataFrame, id_col: str, floor: float = 0.90, least: int = 3, radius2: float = 0.1) -> DataFrame:
    """(cluster_id, id): what is reachable over links of a similarity of at least floor, in clusters of `least` records or more.

    The clusters of the model are the blocks: a record goes to its nearest and to every near-tied one, records linked to a
    block's exemplar are joined there at once, and only the others are compared with the whole block. A block beyond
    vectors.PART_ROWS is cut into parts of linked records (cores) and of others (loose ones); a task compares one loose part with
    one core part or with another loose one, so no task holds more than two parts and cores never meet cores.
    """
    total = df.count()
    model = Model(leaves(df, id_col, leaf_limit(total)), radius2)
    centres, ex_id, ex = model.centres, model.ex_id, model.ex
    ex_unit = V.unit(ex) if ex.any() else ex
    # a record linked to its block's exemplar is linked to one of another block only within twice the angle of the bound
    apart = 2 * floor * floor - 1 - 1e-6

    def blocks(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, block, whether it is linked to the exemplar beyond doubt)."""
        r, c, home = V.near_cells(y, centres)
        at = np.empty(len(y), np.int64)
        at[r[home]] = c[home]
        within = (y * ex_unit[at]).sum(1) >= floor
        stay = home | ~within[r]
        stay[~stay] = (y[r[~stay]] * ex_unit[c[~stay]]).sum(1) >= apart
        r, c = r[stay], c[stay]
        return r, c, (y[r] * ex_unit[c]).sum(1) >= floor + V.SLACK

    sample = V.sample_vectors(df, id_col, SAMPLE_ROWS, total)
    k = len(centres)
    cores, loose = np.zeros(k, np.int64), np.ones(k, np.int64)
    if len(sample):
        _, c, core = blocks(V.unit(sample))
        share = total / len(sample)
        hot = np.bincount(c, minlength=k) * share > V.PART_ROWS
        cores = np.where(hot, np.ceil(np.bincount(c[core], minlength=k) * share / V.PART_ROWS).astype(np.int64), 0)
        loose = np.where(hot, V.parts_for(c[~core], k, share), 1)

    def spread(ids, sides, x, y):
        r, c, core = blocks(y)
        core &= cores[c] > 0
        own = V.salt_of(ids[r], np.where(core, cores[c], loose[c])).astype(np.int64)
        # a core part meets every loose part: tasks core * loose + part
        a = np.flatnonzero(core)
        times = loose[c[a]]
        at = np.repeat(a, times)
        core_task = own[at] * np.repeat(times, times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        # a loose part meets every core part, and every loose one in a task of their own
        b = np.flatnonzero(~core)
        times = cores[c[b]]
        mixed = np.repeat(b, times)
        mixed_task = (np.arange(len(mixed)) - np.repeat(np.cumsum(times) - times, times)) * loose[c[mixed]] + own[mixed]
        pair, pair_task, pair_side = V.in_pairs(own[b], loose[c[b]])
        pair = b[pair]
        pair_task = pair_task + cores[c[pair]] * loose[c[pair]]
        every = np.concatenate([at, mixed, pair])
        side = np.concatenate([np.zeros(len(at), np.int8), np.ones(len(mixed), np.int8), pair_side])
        return r[every], c[every], np.concatenate([core_task, mixed_task, pair_task]), side

    def block(key: tuple, table: pa.Table) -> pa.Table:
        cell, task = key[0].as_py(), key[1].as_py()
        nc, nl = int(cores[cell]), int(loose[cell])
        ids, sides, _, y = V.group_rows(table, short=True)
        first = int((sides == 0).sum())
        ids, y = np.append(ids, ex_id[cell]), np.concatenate([y, ex_unit[cell : cell + 1]])
        label = np.arange(len(ids))
        if task < nc * nl:  # cores (side 0) with a loose part: every core is linked to the exemplar
            label[:first] = len(ids) - 1
            pairs = ((first + a, b, sure) for a, b, sure in V.rough_links(y[first:-1], y[:first], floor))
        elif (task - nc * nl) % (nl + 1):  # two loose parts
            pairs = ((a, first + b, sure) for a, b, sure in V.rough_links(y[:first], y[first:], floor))
        else:  # a part with itself, the exemplar's links first
            near = np.flatnonzero(y @ y[-1] >= floor + V.SLACK)
            label[near] = len(ids) - 1
            rest = np.setdiff1d(np.arange(len(ids)), near)
            pairs = ((rest[a], b, sure) for a, b, sure in V.rough_links(y[rest], y, floor))
        open_a, open_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a, b, sure in pairs:
            label = V.join_labels(label, a[sure], b[sure])
            open_a.append(a[~sure])
            open_b.append(b[~sure])
        a, b = np.concatenate(open_a), np.concatenate(open_b)
        between = (label[a] != label[b]) & (ids[a] != ids[b])
        a, b = ids[a[between]], ids[b[between]]
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, label, ids)
        root = low[label]
        keep = root != ids
        u, v = np.concatenate([ids[keep], np.maximum(a, b)]), np.concatenate([root[keep], np.minimum(a, b)])
        return pa.table({"u": u, "v": v, "sure": np.arange(len(u)) < keep.sum()})

    # vectors travel in 16 bits; of pairs within rounding of the bound, those that would join two trees are computed exactly
    spark = df.sparkSession
    path = f"{V.shared_dir(spark).rstrip('/')}/linked-{uuid.uuid4().hex}"
    V.staged(df, id_col, spread, short=True).groupBy("cell", "task").applyInArrow(block, "u bigint, v bigint, sure boolean").write.parquet(path)
    every = spark.read.parquet(path)
    open_ = every.filter("not sure").select("u", "v").distinct()
    n = open_.count()
    edges = every.filter("sure").select("u", "v")
    found = joined(edges.unionByName(verified(df, id_col, open_, n, floor)) if n else edges)
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return found.join(sizes, "root").select(F.col("root").alias("cluster_id"), F.col("id"))
