"""Evaluation: group statistics, accuracy, loss, pairing, distances of embedding sets, and dense numerics as relational plans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def known(c: str) -> Column:
    """The value, NaN as null."""
    return F.when(~F.isnan(c), F.col(c))


def group_stats(df: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    """mean, count and sample standard deviation of each value by group; NaN and null are skipped; one value has no deviation."""
    aggs = []
    for v in values:
        x = known(v)
        aggs += [F.round(F.avg(x), digits).alias(f"{v}_mean"), F.count(x).alias(f"{v}_count"), F.round(F.stddev_samp(x), digits).alias(f"{v}_std")]
    return df.groupBy(*keys).agg(*aggs)


def relabel(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Keeps the rows whose value is named, with its label and its place in the naming as `place`."""
    pairs = [x for i, (k, v) in enumerate(names.items()) for x in (F.lit(k), F.struct(F.lit(v).alias("label"), F.lit(i).alias("place")))]
    rows = df.withColumn("__n", F.element_at(F.create_map(*pairs), F.col(column))).filter(F.col("__n").isNotNull())
    return rows.withColumn(column, F.col("__n.label")).withColumn("place", F.col("__n.place")).drop("__n")


def target_rank(logits: DataFrame) -> DataFrame:
    """(id, label, rank): place of the labelled entry among the logits of its row, ties by k. A row without the label has none."""
    own = logits.filter(F.col("k") == F.col("label")).select("id", F.col("logit").alias("own"))
    ahead = (F.col("logit") > F.col("own")) | ((F.col("logit") == F.col("own")) & (F.col("k") < F.col("label")))
    return logits.join(own, "id").groupBy("id", "label").agg((F.count(F.when(ahead, 1)) + 1).alias("rank"))


def accuracy_by_range(rows: DataFrame, ranges: list[tuple[float, float]], ks: list[int]) -> DataFrame:
    """(range, k, masked, accuracy, n) of rows (r, masked, rank): the share with rank <= k, r in a half-open range."""
    cell = F.explode(F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(k).alias("k")) for lo, hi in ranges for k in ks]))
    spread = rows.withColumn("cell", cell).filter((F.col("r") >= F.col("cell.lo")) & (F.col("r") < F.col("cell.hi")))
    name = F.concat_ws("-", F.col("cell.lo").cast("string"), F.col("cell.hi").cast("string"))
    return spread.groupBy(name.alias("range"), F.col("cell.k").alias("k"), "masked").agg(F.round(F.avg((F.col("rank") <= F.col("cell.k")).cast("int")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def smoothed_cross_entropy(logits: DataFrame, smoothing: float = 0.1) -> Column:
    """Of rows (id, k, logit, label): one row, loss. Rows whose label is null or outside the vocabulary are ignored."""
    w = W.partitionBy("id")
    top = F.max("logit").over(w)
    rows = logits.withColumn("logp", F.col("logit") - top - F.log(F.sum(F.exp(F.col("logit") - top)).over(w)))
    each = rows.groupBy("id").agg((F.max(F.when(F.col("k") == F.col("label"), -F.col("logp"))) * (1 - smoothing) + F.avg(-F.col("logp")) * smoothing).alias("loss"))
    return each.agg(F.round(F.avg("loss"), 6).alias("loss"), F.count("loss").alias("n"))


def pair_by_number(base: DataFrame, other: DataFrame, key: str = "file") -> tuple[DataFrame, DataFrame]:
    """Both sides with `number`, the key as an integer; keys that are no number are left out."""
    n = F.expr(f"try_cast({key} AS BIGINT)")
    return base.withColumn("number", n).filter("number is not null"), other.withColumn("number", n).filter("number is not null")


def pair_by_place(base: DataFrame, other: DataFrame, key: str, group: str, bucket: float = 4096.0) -> DataFrame:
    """(group, place, base row as b, other row as o): the i-th of base with the i-th of each group of other, in the order of the key.

    The longer side is cut to the shorter one. Both sides keep their key, so callers see whether the i-th ones are alike.
    """
    from gridloom.operators.ordered import rank_along

    b = rank_along(base.withColumn("__one", F.lit(1)), ["__one"], [key], bucket, "place").drop("__one")
    o = rank_along(other, [group], [key], bucket, "place")
    left = b.select("place", F.struct(*base.columns).alias("b"))
    return o.select(group, "place", F.struct(*other.columns).alias("o")).join(left, "place").select(group, "place", "b", "o")


def fully_done(done: DataFrame, item: str, part: str, parts: int) -> DataFrame:
    """Items of which all parts exist."""
    return done.groupBy(item).agg(F.countDistinct(part).alias("n")).filter(F.col("n") >= parts).select(item)


def gaussian(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """One row (n, mean, second): count, mean and second-moment matrix (row by row) of the vectors.

    Each partition sums up its own rows, so the shuffle carries one row a partition.
    """

    def part(batches):
        n, s, m = 0, np.zeros(dim), np.zeros((dim, dim))
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
                n, s, m = n + len(x), s + x.sum(0), m + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s], "m": [m.ravel()]})

    parts = df.select(vec).mapInPandas(part, "n bigint, s array<double>, m array<double>")
    # element-wise sums of few short arrays
    flat = parts.select("n", F.posexplode(F.concat("s", "m")).alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return flat.agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("moments"))


def frechet(a: DataFrame, b: DataFrame, vec: str, dim: int) -> DataFrame:
    """One row, distance: Fréchet distance of the Gaussians of two sets of vectors; the matrix root is taken of a dim x dim result."""

    @F.pandas_udf(T.DoubleType())
    def distance(na: pd.Series, ma: pd.Series, nb: pd.Series, mb: pd.Series) -> pd.Series:
        out = []
        for n1, m1, n2, m2 in zip(na, ma, nb, mb):
            if n1 < 2 or n2 < 2:
                out.append(None)
                continue
            stats = []
            for n, m in ((n1, np.asarray(m1)), (n2, np.asarray(m2))):
                mean = m[:dim] / n
                stats.append((mean, (m[dim:].reshape(dim, dim) - n * np.outer(mean, mean)) / (n - 1)))
            (u1, c1), (u2, c2) = stats
            w, v = np.linalg.eigh(c1)
            root = (v * np.sqrt(np.maximum(w, 0))) @ v.T
            cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ c2 @ root), 0)).sum()
            out.append(float(((u1 - u2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * cross))
        return pd.Series(out, dtype="float64")

    one, two = (gaussian(x, vec, dim).select(F.col("n").alias(f"n{i}"), F.col("moments").alias(f"m{i}")) for i, x in ((1, a), (2, b)))
    return one.crossJoin(two).select(F.round(distance("n1", "m1", "n2", "m2"), 6).alias("distance"))  # one row each


def rms_norm(x: Column, eps: float = 1e-6) -> Column:
    """An array scaled by its root mean square."""
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x)
    return F.transform(x, lambda v: v / F.sqrt(mean + eps))


def mean_pool(df: DataFrame, key: str, layers: str) -> DataFrame:
    """(key, dim, value): the mean over the layers of each record."""
    rows = df.select(key, F.explode(layers).alias("layer")).select(key, F.posexplode("layer").alias("dim", "x"))
    return rows.groupBy(key, "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"))


def project(df: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, out, value): rows (key, k, x) times weights (k, out, w), as a join and a sum. The weights are broadcast where the session's own size rule allows."""
    return df.join(weights, "k").groupBy(key, "out").agg(F.sum(F.col("x") * F.col("w")).alias("value"))


def embed_codes(grid: DataFrame, vectors: DataFrame) -> DataFrame:
    """Tokens with the vector of their codebook and code, from a table (codebook, code, vector) that also lists special tokens."""
    return grid.join(vectors, ["codebook", "code"], "left")
