"""Connected components of links, distributed: alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import shared_dir


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends there, and they are computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/links-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(id, root) for every node of the edges (u, v), root the smallest id of its component.

    Null ends and loops are dropped; an empty table gives an empty result. Every step is a grouped minimum and a join,
    so a hub with a third of all links is aggregated before its shuffle and its join is split by skew handling.
    Lineage is cut with a table in the shared folder after each round.
    """
    shared_dir(edges.sparkSession)
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    now = _written(now)
    mark = _mark(now)
    # each round halves the paths at least nearly; the bound only guards against a fault
    for _ in range(most_rounds):
        if not mark[0]:
            break
        # large star: every node hangs its larger neighbours on its smallest one
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        # small star: every node and its smaller neighbours hang on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
        after = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = _written(after)
        new = _mark(after)
        now = after
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def joined(rows: DataFrame) -> DataFrame:
    """(id, root) like components, for rows (u, v) in which a node u names few v (its smallest partners in some blocks).

    Every u first keeps its smallest v; only what links one v with another goes through the rounds.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/joined-{uuid.uuid4().hex}"
    rows.filter("u > v").groupBy("u").agg(F.collect_set("v").alias("vs")).select("u", F.array_min("vs").alias("m"), "vs").write.parquet(path)
    own = spark.read.parquet(path)  # read by each use below
    between = own.filter(F.size("vs") > 1).select("m", F.explode("vs").alias("v")).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # a v that is itself a u hangs on its own smallest
    heads = own.select(F.explode("vs").alias("id")).distinct()
    chained = own.select(F.col("u").alias("id"), "m").join(heads, "id").select(F.col("id").alias("u"), F.col("m").alias("v"))
    top = components(between.unionByName(chained))
    ids = own.select(F.col("u").alias("id"), F.col("m")).unionByName(own.select(F.col("m").alias("id"), "m").distinct())
    rooted = ids.join(top.select(F.col("id").alias("m"), "root"), "m", "left").select("id", F.coalesce("root", "m").alias("root"))
    return rooted.unionByName(top.select("id", "root")).groupBy("id").agg(F.min("root").alias("root"))
