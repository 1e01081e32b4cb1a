"""Beats and segments: consecutive segments, containment, beat-synchronous aggregates, windows, snapping.

Orders along a clip come from operators.ordered, so an endless clip is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.ordered import next_value, rank_along, running_sum

#: Named aggregates for features between beats.
AGGREGATES = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min}
#: Seconds of a bucket when beats are ordered.
BUCKET = 60.0


def segments(beats: DataFrame, durations: DataFrame, bucket: float = BUCKET) -> DataFrame:
    """(clip_id, start, end, downbeat): 0, the beats and the clip's end (clip_id, end_s) in order, paired with the next.

    A segment is a downbeat if its start is the time of one. Clips of unknown duration end at their last beat. Repeated times
    make one segment; beats outside the clip are left out.
    """
    inside = beats.join(durations, "clip_id").filter((F.col("beat_s") >= 0) & (F.col("end_s").isNull() | (F.col("beat_s") <= F.col("end_s"))))
    at = inside.select("clip_id", F.col("beat_s").alias("start"), F.col("is_downbeat").alias("downbeat"))
    ends = durations.select("clip_id", F.lit(0.0).alias("start"), F.lit(False).alias("downbeat")).unionByName(durations.filter("end_s is not null").select("clip_id", F.col("end_s").alias("start"), F.lit(False).alias("downbeat")))
    points = at.unionByName(ends).groupBy("clip_id", "start").agg(F.bool_or("downbeat").alias("downbeat"))
    return next_value(points, ["clip_id"], "start", bucket, "end").filter(F.col("end").isNotNull()).select("clip_id", "start", "end", "downbeat")


def first_containing(queries: DataFrame, containers: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Queries (keys, start, end) with the first container (keys, ord, c_start, c_end), by ord, that holds them whole, or nulls.

    Containers are entered in every time cell they touch and queries in the cell of their start, so the join is by equality.
    """
    cell = lambda c: F.floor(c / width).cast("bigint")
    spread = containers.filter(F.col("c_start") <= F.col("c_end")).withColumn("__cell", F.explode(F.sequence(cell(F.col("c_start")), cell(F.col("c_end")))))
    rows = queries.withColumn("__cell", cell(F.col("start")))
    hit = rows.join(spread, [*keys, "__cell"]).filter((F.col("c_start") <= F.col("start")) & (F.col("c_end") >= F.col("end")))
    best = hit.groupBy(*keys, "start", "end").agg(F.min(F.struct("ord", "c_start", "c_end")).alias("c"))
    return queries.join(best, [*keys, "start", "end"], "left").select(*queries.columns, F.col("c.ord").alias("ord"), F.col("c.c_start").alias("c_start"), F.col("c.c_end").alias("c_end"))


def sync_features(features: DataFrame, marks: DataFrame, key: str, order: str, value: str, width: float, aggregate: str = "median") -> DataFrame:
    """(key, segment, value): features aggregated between consecutive marks; segment counts the marks at or before a feature.

    features: (key, order, value); marks: (key, order). Equal positions: the mark comes first.
    """
    if aggregate not in AGGREGATES:
        raise ValueError(f"unknown aggregate {aggregate}")
    both = features.select(key, order, F.col(value).alias("v"), F.lit(0).alias("mark")).unionByName(marks.select(key, order, F.lit(None).cast("double").alias("v"), F.lit(1).alias("mark")))
    both = both.withColumn("__last", 1 - F.col("mark"))
    counted = running_sum(both, [key], [order, "__last"], width, F.col("mark"), "segment")
    return counted.filter("mark = 0").groupBy(key, "segment").agg(AGGREGATES[aggregate]("v").alias("value"))


def strided(beats: DataFrame, stride: int, bucket: float = BUCKET) -> DataFrame:
    """Every stride-th beat of a clip, from the first."""
    return rank_along(beats, ["clip_id"], ["beat_s"], bucket).filter((F.col("rank") - 1) % stride == 0).drop("rank")


def without_downbeats(beats: DataFrame, to_token: Column) -> DataFrame:
    """(clip_id, token) of beats whose token no downbeat has; repeated ones stay."""
    rows = beats.select("clip_id", to_token.alias("token"), "is_downbeat")
    return rows.select("clip_id", "token").join(rows.filter("is_downbeat").select("clip_id", "token").distinct(), ["clip_id", "token"], "left_anti")


def windows(durations: DataFrame, length: float, hop: float) -> DataFrame:
    """(clip_id, i, start, end): windows that start before the clip's end, the last cut there. hop = length gives tumbling ones."""
    n = F.ceil(F.col("end_s") / hop).cast("int")
    rows = durations.filter("end_s > 0").withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select("clip_id", "i", (F.col("i") * hop).alias("start"), F.least(F.col("i") * hop + length, F.col("end_s")).alias("end"))


def snap(grid: DataFrame, beats: DataFrame, to_token: Column) -> DataFrame:
    """Cells between the first and the last beat of their clip; clips without beats lose all."""
    span = beats.groupBy("clip_id").agg(F.min(to_token).alias("__lo"), F.max(to_token).alias("__hi"))
    return grid.join(span, "clip_id").filter((F.col("t") >= F.col("__lo")) & (F.col("t") < F.col("__hi"))).drop("__lo", "__hi")


def beats_json(beats: DataFrame, seconds: float = 3600.0) -> DataFrame:
    """(clip_id, part, json) with the sorted times of beats and downbeats, a document for each hour of a clip, so that an endless one is many."""
    times = beats.groupBy("clip_id", F.floor(F.col("beat_s") / seconds).alias("part")).agg(F.sort_array(F.collect_list("beat_s")).alias("beats"), F.sort_array(F.collect_list(F.when(F.col("is_downbeat"), F.col("beat_s")))).alias("downbeats"))
    return times.select("clip_id", "part", F.to_json(F.struct("clip_id", "part", "beats", "downbeats")).alias("json"))
