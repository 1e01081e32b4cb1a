"""Bindings of the tables to the logical schemas: token grids, beats, clips, metric rows, logits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Token that stands for a masked cell; codes lie below it.
MASK = 1024
#: Sample rate and samples a token.
RATE, HOP = 44100, 768


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def clean_grid(tokens: DataFrame) -> DataFrame:
    """(clip_id, codebook, t, code): every cell once. Null keys and negative positions are dropped; a code that is null or out of range is null; of repeated cells the smallest code stays."""
    code = F.when(F.col("code").between(0, MASK), F.col("code"))
    known = tokens.filter(F.col("clip_id").isNotNull() & F.col("codebook").isNotNull() & (F.col("t") >= 0))
    return known.groupBy("clip_id", "codebook", "t").agg(F.min(code).alias("code"))


def with_extent(grid: DataFrame) -> DataFrame:
    """Adds steps and codebooks of the clip. The extents are one narrow row a clip, joined back, so no clip is one task's window."""
    extent = grid.groupBy("clip_id").agg((F.max("t") + 1).alias("steps"), (F.max("codebook") + 1).alias("codebooks"))
    return grid.join(extent, "clip_id")


def token_grid(spark: SparkSession, d: str) -> DataFrame:
    """(clip_id, codebook, t, code, steps, codebooks).

    The extents come from the scan, where one aggregation per partition reduces them to a row a clip before they move.
    """
    tokens = table(spark, d, "tokens")
    known = tokens.filter(F.col("clip_id").isNotNull() & F.col("codebook").isNotNull() & (F.col("t") >= 0))
    extent = known.groupBy("clip_id").agg((F.max("t") + 1).alias("steps"), (F.max("codebook") + 1).alias("codebooks"))
    return clean_grid(tokens).join(extent, "clip_id")


def clip_steps(spark: SparkSession, d: str) -> DataFrame:
    """(clip_id, steps), aggregated from the scan at once: cheaper than from the grid."""
    t = table(spark, d, "tokens").filter(F.col("clip_id").isNotNull() & F.col("codebook").isNotNull() & (F.col("t") >= 0))
    return t.groupBy("clip_id").agg((F.max("t") + 1).alias("steps"))


def clean_beats(beats: DataFrame) -> DataFrame:
    """(clip_id, beat_s, is_downbeat): each time once a clip, a downbeat if any of its rows says so; null and NaN times are dropped."""
    known = beats.filter(F.col("clip_id").isNotNull() & F.col("beat_s").isNotNull() & ~F.isnan("beat_s"))
    return known.groupBy("clip_id", "beat_s").agg(F.coalesce(F.bool_or("is_downbeat"), F.lit(False)).alias("is_downbeat"))


def beats(spark: SparkSession, d: str) -> DataFrame:
    return clean_beats(table(spark, d, "beats"))


def clips(spark: SparkSession, d: str) -> DataFrame:
    """The latest delivery of every clip."""
    cols = ["path", "label", "sample_rate", "duration_ms", "loudness", "peak", "dbfs"]
    rows = table(spark, d, "clips").filter(F.col("clip_id").isNotNull())
    latest = rows.groupBy("clip_id").agg(F.max(F.struct("ingested_at", *cols)).alias("r"))
    return latest.select("clip_id", *[F.col(f"r.{c}").alias(c) for c in cols])


def metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """(condition, file, mel, frechet): rows once, NaN as null."""
    none = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return table(spark, d, "metrics").filter("condition is not null and file is not null").select("condition", "file", none("mel"), none("frechet")).distinct()


def logits(spark: SparkSession, d: str) -> DataFrame:
    """(id, k, logit, label) from the flat vectors: one distribution a vector."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", F.posexplode("embedding").alias("k", "x")).select("id", "k", F.col("x").cast("double").alias("logit"), "label")


def audio_catalog(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("wav", "mp3", "flac", "aac", "ogg"), recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime, extension, label) of the audio files below a folder; the label is the folder that holds the file. Contents are not read."""
    from gridloom.functions import text

    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    rows = files.select("path", "length", "modificationTime", text.suffix(F.col("path")).alias("extension"), text.parent_name(F.col("path")).alias("label"))
    return rows.filter(F.col("extension").isin(*["." + e for e in extensions]))
