"""Named queries with the SQL each is compared with; SQL fragments that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its SQL if SQL can express it."""

    def wrap(f):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered already")
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return wrap


def u(salt: str, *keys: str) -> str:
    """The hashed uniform of functions.rng in SQL."""
    parts = ", ".join([f"'{salt}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {parts})), 1, 8)) AS BIGINT) / 4294967296.0)"


CELL = ("clip_id", "codebook", "t")
#: Every cell once, with steps and codebooks of its clip, as `g`.
GRID = """
WITH grid AS (
  SELECT clip_id, codebook, t, min(CASE WHEN code BETWEEN 0 AND 1024 THEN code END) AS code FROM tokens
  WHERE clip_id IS NOT NULL AND codebook IS NOT NULL AND t >= 0 GROUP BY ALL),
ext AS (SELECT clip_id, max(t) + 1 AS steps, max(codebook) + 1 AS codebooks FROM grid GROUP BY 1),
g AS (SELECT * FROM grid JOIN ext USING (clip_id))
"""
#: Every beat once, as `bt`.
BEATS = """
bt AS (SELECT clip_id, beat_s, coalesce(bool_or(is_downbeat), false) AS is_downbeat FROM beats
  WHERE clip_id IS NOT NULL AND beat_s IS NOT NULL AND NOT isnan(beat_s) GROUP BY 1, 2)
"""
#: The latest delivery of every clip, as `cl`.
CLIPS = """
cl AS (SELECT clip_id, path, label, sample_rate, duration_ms, loudness, peak, dbfs FROM clips WHERE clip_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY ingested_at DESC, path DESC) = 1)
"""
#: Metric rows once, NaN as null, as `mt`.
METRICS = """
mt AS (SELECT DISTINCT condition, file, CASE WHEN NOT isnan(mel) THEN mel END AS mel, CASE WHEN NOT isnan(frechet) THEN frechet END AS frechet
  FROM metrics WHERE condition IS NOT NULL AND file IS NOT NULL)
"""
#: One distribution a vector, as `lg`.
LOGITS = """
lg AS (SELECT vec_id AS id, label, unnest(range(len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS logit FROM embeddings)
"""


def slice_sql(s: str, size: str) -> str:
    return f"(CASE WHEN {s} < 0 THEN greatest({size} + {s}, 0) ELSE least({s}, {size}) END)"
