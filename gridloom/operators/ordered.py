"""Ranks, running sums and next values along an order, without one task for a key.

Rows of a key are cut into buckets of the order column. Counts or sums of buckets, one narrow row each, are accumulated along
the key, and a window orders only the rows of one (key, bucket). A key that holds a third of all rows is spread this way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_B = "__bucket"


def _bucketed(df: DataFrame, order: str, width: float) -> DataFrame:
    return df.withColumn(_B, F.floor(F.col(order) / width).cast("bigint"))


def rank_along(df: DataFrame, keys: list[str], order: list[str], width: float, name: str = "rank") -> DataFrame:
    """Adds the 1-based place of each row of a key by the order columns; the first of them is cut into buckets of that width."""
    rows = _bucketed(df, order[0], width)
    n = rows.groupBy(*keys, _B).agg(F.count(F.lit(1)).alias("__n"))
    along = W.partitionBy(*keys).orderBy(_B).rowsBetween(W.unboundedPreceding, -1)
    before = n.select(*keys, _B, F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__before"))
    inner = F.row_number().over(W.partitionBy(*keys, _B).orderBy(*order))
    return rows.withColumn(name, inner).join(before, [*keys, _B]).withColumn(name, F.col(name) + F.col("__before")).drop(_B, "__before")


def running_sum(df: DataFrame, keys: list[str], order: list[str], width: float, value: Column, name: str) -> DataFrame:
    """Adds the sum of value over the rows of the key up to and with this one."""
    rows = _bucketed(df, order[0], width).withColumn("__v", value)
    s = rows.groupBy(*keys, _B).agg(F.sum("__v").alias("__s"))
    along = W.partitionBy(*keys).orderBy(_B).rowsBetween(W.unboundedPreceding, -1)
    before = s.select(*keys, _B, F.coalesce(F.sum("__s").over(along), F.lit(0)).alias("__before"))
    inner = F.sum("__v").over(W.partitionBy(*keys, _B).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(name, inner).join(before, [*keys, _B]).withColumn(name, F.col(name) + F.col("__before")).drop(_B, "__before", "__v")


def next_value(df: DataFrame, keys: list[str], order: str, width: float, name: str = "next") -> DataFrame:
    """Adds the next value of the order column within the key, null at its end."""
    rows = _bucketed(df, order, width)
    first = rows.groupBy(*keys, _B).agg(F.min(order).alias("__first"))
    follow = first.select(*keys, _B, F.lead("__first").over(W.partitionBy(*keys).orderBy(_B)).alias("__follow"))
    inner = F.lead(order).over(W.partitionBy(*keys, _B).orderBy(order))
    return rows.withColumn(name, inner).join(follow, [*keys, _B]).withColumn(name, F.coalesce(name, "__follow")).drop(_B, "__follow")


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends there, and they are computed once."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{base.rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
