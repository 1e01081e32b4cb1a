"""Whole-grid operations: concatenation, padding, repetition, trimming, excerpts, attention over small sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def concat_time(first: DataFrame, second: DataFrame) -> DataFrame:
    """(clip_id, codebook, t, code): the second grid's steps behind the first's of the same clip; a clip of one side alone stays."""
    length = first.groupBy("clip_id").agg((F.max("t") + 1).alias("__n"))
    cols = ["clip_id", "codebook", "t", "code"]
    moved = second.select(*cols).join(length, "clip_id", "left").withColumn("t", (F.col("t") + F.coalesce("__n", F.lit(0))).cast("int"))
    return first.select(*cols).unionByName(moved.select(*cols))


def concat_codebooks(first: DataFrame, second: DataFrame, codebooks: int) -> DataFrame:
    """The second grid's codebooks numbered on from the first's."""
    cols = ["clip_id", "codebook", "t", "code"]
    return first.select(*cols).unionByName(second.select("clip_id", (F.col("codebook") + codebooks).cast("int").alias("codebook"), "t", "code"))


def repeat_steps(grid: DataFrame, times: int) -> DataFrame:
    """Every step repeated in place and cut to the clip's old length."""
    rows = grid.withColumn("t", F.explode(F.sequence(F.col("t") * times, F.col("t") * times + times - 1)))
    return rows.filter(F.col("t") < F.col("steps"))


def trim_context(rows: DataFrame, condition: str, steps_per_second: float) -> DataFrame:
    """Rows (condition, t, steps) of inpainting conditions without the context that their name's last part gives in seconds, at either end; other conditions stay whole."""
    c = F.floor(F.expr(f"try_cast(element_at(split({condition}, '_'), -1) as double)") * steps_per_second)
    inside = (F.col("t") >= c) & (F.col("t") < F.col("steps") - c)
    return rows.filter(~F.col(condition).contains("inpaint") | F.coalesce(inside, F.lit(True)))


def pad_cells(grid: DataFrame, multiple: int, code: int = 0) -> DataFrame:
    """The grid with cells of the code up to the next multiple of steps; unpad by t < steps."""
    tail = grid.select("clip_id", "codebook", "steps").distinct().withColumn("to", F.ceil(F.col("steps") / multiple) * multiple).filter("to > steps")
    more = tail.select("clip_id", "codebook", F.explode(F.sequence(F.col("steps"), F.col("to").cast("int") - 1)).alias("t"), F.lit(code).alias("code"), "steps")
    return grid.select("clip_id", "codebook", "t", "code", "steps").unionByName(more)


def salient_excerpt(rows: DataFrame, key: str, at: str, level: str, length: int, least: float) -> DataFrame:
    """(key, start, level): of the consecutive excerpts of so many steps with a mean level of at least `least`, the loudest, the earliest of equal ones."""
    parts = rows.groupBy(key, F.floor(F.col(at) / length).alias("part")).agg(F.round(F.avg(level), 6).alias("level"))
    best = parts.filter(F.col("level") >= least).groupBy(key).agg(F.max(F.struct("level", -F.col("part"))).alias("b"))
    return best.select(key, (-F.col("b.col2") * length).cast("bigint").alias("start"), F.col("b.level").alias("level"))


def rms_level(x: Column) -> Column:
    """Root-mean-square level of an array in dB; silence and empty arrays have none."""
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x)
    return F.when((F.size(x) > 0) & (mean > 0), F.log10(mean) * 10)


def attention(queries: DataFrame, keys: DataFrame, group: str, bias: Column | None = None) -> DataFrame:
    """(group, q, dim, value): softmax-weighted sums of keys' values within groups of bounded size (sequences).

    queries: (group, q, vec); keys: (group, k, vec, value), all vectors as arrays. bias is a column over q and k.
    """
    pairs = queries.withColumnRenamed("vec", "__q").join(keys.withColumnRenamed("vec", "__k"), group)
    dot = F.aggregate(F.zip_with("__q", "__k", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v) / F.sqrt(F.size("__q").cast("double"))
    scored = pairs.withColumn("__s", dot + bias if bias is not None else dot)
    w = W.partitionBy(group, "q")
    scored = scored.withColumn("__e", F.exp(F.col("__s") - F.max("__s").over(w))).withColumn("__w", F.col("__e") / F.sum("__e").over(w))
    return scored.select(group, "q", "__w", F.posexplode("value").alias("dim", "v")).groupBy(group, "q", "dim").agg(F.sum(F.col("__w") * F.col("v")).alias("value"))
