"""Outputs in the forms that downstream tools read: statistics, masks, manifests, tagged snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_stats(stats: DataFrame, folder: str, metrics: list[str]) -> None:
    """One CSV with a header per metric, stats-{metric}; a row a group, so one file each."""
    keys = [c for c in stats.columns if not any(c.startswith(m + "_") for m in metrics)]
    for m in metrics:
        stats.select(*keys, *[c for c in stats.columns if c.startswith(m + "_")]).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/stats-{m}")


def mask_lines(masked: DataFrame, steps: int = 4096) -> DataFrame:
    """(clip_id, part, value): the mask of the first codebook as lines of 0s and 1s in the order of t, at most so many steps a line.

    A clip of no more steps is one line; the lines of an endless one are made in tasks of their own and belong one behind another.
    """
    rows = masked.filter("codebook = 0").groupBy("clip_id", F.floor(F.col("t") / steps).alias("part")).agg(F.sort_array(F.collect_list(F.struct("t", "m"))).alias("cells"))
    return rows.select("clip_id", "part", F.array_join(F.transform("cells", lambda c: c["m"].cast("string")), " ").alias("value"))


def write_wide(rows: DataFrame, keys: list[str], path: str, key: str = "key", value: str = "value") -> None:
    """A CSV with a header whose columns are the keys and whatever names the data has, in order; a name that a row lacks is empty."""
    rows.groupBy(*keys).pivot(key).agg(F.first(value)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_manifest(df: DataFrame, path: str, split: str = "split", name: str = "name", most: int = 50_000) -> None:
    """JSON lines {split, part, names}: the names of each split, sorted, at most about so many a line."""
    parts = F.pmod(F.xxhash64(name), F.lit(max(1, df.count() // most + 1)))
    rows = df.groupBy(split, parts.alias("part")).agg(F.sort_array(F.collect_list(name)).alias("names"))
    rows.write.mode("overwrite").json(path)


def write_split(df: DataFrame, path: str, split: str = "split") -> None:
    """Partitioned by split, so a reader of one split reads only its files."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_documents(df: DataFrame, path: str, column: str = "json") -> None:
    """One JSON document a line."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def stamped_name(modified: F.Column, name: str, suffix: str) -> F.Column:
    """{yyyyMMddHHmmss}_{name}{suffix} from a modification time, in the session's time zone."""
    return F.concat(F.date_format(modified, "yyyyMMddHHmmss"), F.lit(f"_{name}{suffix}"))


def newest(catalog: DataFrame) -> DataFrame:
    """(path) of the newest entry of a catalog with modificationTime."""
    return catalog.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))


def tagged_writer(folder: str, save_at: tuple[int, ...] = (), order: str = "step", value: str = "loss"):
    """A foreachBatch writer: each batch's last row becomes `latest`, of a save step also `{step // 1000}k`, and of the best value so far `best`.

    The best is kept in the folder, so it survives a restart; a batch that is run again writes the same.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = batch.orderBy(F.desc(order)).limit(1).persist()
        try:
            head = last.first()
            if head is None:
                return
            tags = ["latest"] + [f"{s // 1000}k" for s in save_at if s == head[order]]
            try:
                best = spark.read.parquet(f"{folder}/best").first()[value]
            except Exception:  # no best yet
                best = None
            if best is None or (head[value] is not None and head[value] < best):
                tags.append("best")
            for tag in tags:
                last.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{tag}")
        finally:
            last.unpersist()

    return write
