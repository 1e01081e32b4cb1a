"""Sources and sinks as queries: what is written is read again and compared with what it came from."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.operators import conditions, metrics
from gridloom.operators import masks as M
from gridloom.sources import sinks
from gridloom.sources.grid import metric_rows, table, token_grid

from .registry import GRID, METRICS, query, u
from .shared import ensure_checkpoint_dir


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("WITH " + METRICS + "SELECT condition, CAST(count(mel) AS BIGINT) AS mel_count, round(avg(mel), 6) AS mel_mean FROM mt GROUP BY 1")
def stats_csv_roundtrip(spark, d):
    """Group statistics written as CSV and read again."""
    folder = _folder(spark, "stats")
    sinks.write_stats(metrics.group_stats(metric_rows(spark, d), ["condition"], ["mel", "frechet"]), folder, ["mel", "frechet"])
    return spark.read.option("header", True).schema("condition string, mel_mean double, mel_count bigint, mel_std double").csv(f"{folder}/stats-mel").select("condition", "mel_count", "mel_mean")


@query(GRID + "SELECT clip_id, CAST(t // 4096 AS BIGINT) AS part, string_agg(CAST(CASE WHEN t < 3 OR t >= steps - 2 THEN 0 ELSE 1 END AS VARCHAR), ' ' ORDER BY t) AS value FROM g WHERE codebook = 0 GROUP BY 1, 2")
def mask_text(spark, d):
    """Masks of the first codebook as lines of at most 4 096 steps."""
    return sinks.mask_lines(token_grid(spark, d).withColumn("m", M.inpaint(3, 2).cast("int")))


@query("WITH h AS (SELECT doc_id, CAST(('0x' || substr(md5('7|' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) AS h FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS r, count(*) OVER () AS n FROM h) SELECT CASE WHEN r <= ceil(n * 0.1) THEN 'test' ELSE 'train' END AS split, 'doc_' || doc_id AS name FROM r")
def split_manifest(spark, d):
    """A split written as a manifest of names and read again."""
    from gridloom.operators import prep

    folder = _folder(spark, "manifest")
    sinks.write_manifest(prep.split_by_hash(table(spark, d, "documents").select("doc_id"), "doc_id", 0.1, 7).select("split", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name")), folder)
    return spark.read.schema("split string, part bigint, names array<string>").json(folder).select("split", F.explode("names").alias("name"))


@query("SELECT unnest(['genre_embeddings.parquet', 'annotated_embeddings.parquet']) AS name")
def glob_scan(spark, d):
    """Files of a folder by a pattern of their names, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*_embeddings.parquet").load(d)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))


@query("SELECT lang, CAST(count(*) AS BIGINT) AS n FROM (SELECT coalesce(lower(trim(lang)), 'none') AS lang FROM documents) GROUP BY 1")
def partitioned_write(spark, d):
    """Documents written by language, counted from the folders."""
    path = _folder(spark, "langs")
    sinks.write_split(table(spark, d, "documents").select("doc_id", F.coalesce(F.lower(F.trim("lang")), F.lit("none")).alias("lang")), path, "lang")
    back = spark.read.option("basePath", path).schema("doc_id bigint, lang string").parquet(path)
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))




_KEYS = ("clip_id", "codebook", "t")
_RATIO = lambda r: f"CASE WHEN {u('linear', *_KEYS)} < {r} THEN 1 ELSE 0 END"
#: Each condition's mask and code in SQL.
_SUITES = {
    "gen-compression": {"baseline": ("0", None), "reconstructed": ("0", None), **{f"mask_ratio_{r}": (_RATIO(r), "1024") for r in (0.25, 0.5, 0.75)}, **{f"token_noise_{r}": (_RATIO(r), f"floor({u('noise', *_KEYS)} * 1024)") for r in (0.1, 0.25)}},
    "inpaint": {"baseline": ("0", None), **{f"inpaint_{s}": (f"CASE WHEN t < {int(s * 57)} OR t >= steps - {int(s * 57)} THEN 0 ELSE 1 END", "1024") for s in (0.5, 1.0, 2.0)}},
    "periodic": {"baseline": ("0", None), **{f"periodic_{p}": (f"CASE WHEN t % {p} = 0 THEN 0 ELSE 1 END", "1024") for p in (3, 7, 13)}, "coarse2fine": ("CASE WHEN t % 4 = 0 THEN 0 ELSE 1 END", "1024")},
}
_CONDITIONS = " UNION ALL ".join(f"SELECT '{s}' AS suite, '{c}' AS condition, {m} AS m, {f'CASE WHEN ({m}) = 1 THEN {x} ELSE code END' if x else 'code'} AS code FROM g" for s, of in _SUITES.items() for c, (m, x) in of.items())


@query(GRID + f" SELECT suite, condition, CAST(count(*) AS BIGINT) AS cells, CAST(sum(m) AS BIGINT) AS masked, CAST(sum(code) AS BIGINT) AS codes FROM ({_CONDITIONS}) GROUP BY 1, 2")
def condition_suite(spark, d):
    """All suites of named conditions over every clip."""
    grid, out = token_grid(spark, d), None
    for suite in conditions.SUITES:
        rows = conditions.run(grid, suite).groupBy("condition").agg(F.count(F.lit(1)).alias("cells"), F.sum("m").cast("bigint").alias("masked"), F.sum("code").cast("bigint").alias("codes"))
        rows = rows.select(F.lit(suite).alias("suite"), "condition", "cells", "masked", "codes")
        out = rows if out is None else out.unionByName(rows)
    return out


@query()
def wav_roundtrip(spark, d):
    """Every vector written as a WAV file and read again: the largest difference is below one quantisation step."""
    from gridloom.sources.wav import WavDataSource

    spark.dataSource.register(WavDataSource)
    folder = _folder(spark, "wav")
    rows = table(spark, d, "embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit(".wav")).alias("path"), F.lit(44100).alias("sample_rate"), F.lit(1).alias("channels"), F.lit(64).cast("bigint").alias("frames"), F.transform("embedding", lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v.cast("double"))).cast("float")).alias("samples"))
    rows.write.format("wav").mode("append").save(folder)
    back = spark.read.format("wav").load(folder).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("path"), F.col("samples").alias("back"))
    gap = F.aggregate(F.zip_with("samples", "back", lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda a, b: F.greatest(a, b))
    return rows.join(back, "path").select("path", (gap < 1 / 32000).alias("exact"), F.size("back").alias("frames"))
