"""Beats, segments, windows and token time over the media tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.operators import beats as B
from gridloom.sources.grid import HOP, RATE, beats, clips, table, token_grid

from .registry import BEATS, CELL, CLIPS, GRID, query

_TOK = f"CAST(ceil(beat_s * {RATE} / {HOP}) AS INTEGER)"
_DUR = "du AS (SELECT clip_id, duration_ms / 1000.0::DOUBLE AS end_s FROM cl)"
_SEG = f"""
ins AS (SELECT clip_id, beat_s AS s, is_downbeat AS d FROM bt JOIN du USING (clip_id) WHERE beat_s >= 0 AND (end_s IS NULL OR beat_s <= end_s)),
pts AS (SELECT clip_id, s, bool_or(d) AS d FROM (SELECT * FROM ins UNION ALL SELECT clip_id, 0.0, false FROM du UNION ALL SELECT clip_id, end_s, false FROM du WHERE end_s IS NOT NULL) GROUP BY 1, 2),
seg AS (SELECT clip_id, s AS start_s, lead(s) OVER (PARTITION BY clip_id ORDER BY s) AS end_s, d AS downbeat FROM pts)
"""


def _durations(spark, d):
    return clips(spark, d).select("clip_id", (F.col("duration_ms") / F.lit(1000.0)).alias("end_s"))


def _segments(spark, d):
    return B.segments(beats(spark, d), _durations(spark, d))


@query("WITH " + BEATS + "," + CLIPS + "," + _DUR + "," + _SEG + "SELECT clip_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, downbeat FROM seg WHERE end_s IS NOT NULL")
def beat_segments(spark, d):
    return _segments(spark, d).select("clip_id", F.round("start", 6).alias("start_s"), F.round("end", 6).alias("end_s"), "downbeat")


@query("WITH " + BEATS + "," + CLIPS + "," + _DUR + "," + _SEG + """,
w AS (SELECT clip_id, i AS ord, i * 2.5 AS c_start, i * 2.5 + 5 AS c_end FROM (SELECT clip_id, unnest(range(CAST(ceil(end_s / 2.5) AS BIGINT))) AS i FROM du WHERE end_s > 0))
SELECT s.clip_id, round(s.start_s, 6) AS start_s, round(s.end_s, 6) AS end_s, CAST((SELECT min(ord) FROM w WHERE w.clip_id = s.clip_id AND c_start <= s.start_s AND c_end >= s.end_s) AS INTEGER) AS ord FROM seg s WHERE s.end_s IS NOT NULL""")
def first_containing_segment(spark, d):
    """Beat segments with the first five-second window that holds them whole."""
    w = _durations(spark, d).filter("end_s > 0").withColumn("ord", F.explode(F.sequence(F.lit(0), F.ceil(F.col("end_s") / 2.5).cast("int") - 1)))
    w = w.select("clip_id", "ord", (F.col("ord") * 2.5).alias("c_start"), (F.col("ord") * 2.5 + 5).alias("c_end"))
    rows = B.first_containing(_segments(spark, d).drop("downbeat"), w, ["clip_id"], 5.0)
    return rows.select("clip_id", F.round("start", 6).alias("start_s"), F.round("end", 6).alias("end_s"), "ord")


@query(GRID + "," + BEATS + f""",
fe AS (SELECT clip_id, CAST(t AS DOUBLE) AS x, CAST(code AS DOUBLE) AS v, 0 AS mark FROM g WHERE codebook = 0), ma AS (SELECT DISTINCT clip_id, CAST({_TOK} AS DOUBLE) AS x, NULL::DOUBLE AS v, 1 AS mark FROM bt WHERE beat_s >= 0),
c AS (SELECT *, sum(mark) OVER (PARTITION BY clip_id ORDER BY x, 1 - mark ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM (SELECT * FROM fe UNION ALL SELECT * FROM ma))
SELECT clip_id, CAST(segment AS BIGINT) AS segment, median(v) AS value FROM c WHERE mark = 0 GROUP BY 1, 2""")
def beat_sync_features(spark, d):
    """The median code of the first codebook between consecutive beats."""
    feats = token_grid(spark, d).filter("codebook = 0").select("clip_id", F.col("t").cast("double").alias("x"), F.col("code").cast("double").alias("code"))
    marks = beats(spark, d).filter("beat_s >= 0").select("clip_id", scalar.seconds_to_tokens(F.col("beat_s"), RATE, HOP).cast("double").alias("x")).distinct()
    return B.sync_features(feats, marks, "clip_id", "x", "code", 256.0).select("clip_id", F.col("segment").cast("bigint").alias("segment"), "value")


@query("WITH " + BEATS + f"SELECT clip_id, round(beat_s, 6) AS beat_s, {_TOK} AS token, round({_TOK} * {HOP} / CAST({RATE} AS DOUBLE), 6) AS snapped_s, CAST(trunc(beat_s * {RATE} / 441000 * 862) AS BIGINT) AS frame FROM bt")
def seconds_tokens(spark, d):
    s = F.col("beat_s")
    return beats(spark, d).select("clip_id", F.round(s, 6).alias("beat_s"), scalar.seconds_to_tokens(s, RATE, HOP).alias("token"), F.round(scalar.snap_seconds(s, RATE, HOP), 6).alias("snapped_s"), scalar.feature_frame(s, RATE, 441000, 862).alias("frame"))


@query("WITH " + BEATS + f", tk AS (SELECT clip_id, {_TOK} AS token, is_downbeat FROM bt) SELECT clip_id, token FROM tk WHERE (clip_id, token) NOT IN (SELECT (clip_id, token) FROM tk WHERE is_downbeat)")
def beats_minus_downbeats(spark, d):
    return B.without_downbeats(beats(spark, d), scalar.seconds_to_tokens(F.col("beat_s"), RATE, HOP))


@query("WITH " + BEATS + "SELECT clip_id, beat_s FROM bt WHERE is_downbeat INTERSECT SELECT clip_id, beat_s FROM bt")
def beats_and_downbeats(spark, d):
    rows = beats(spark, d)
    return rows.filter("is_downbeat").select("clip_id", "beat_s").intersect(rows.select("clip_id", "beat_s"))


@query("WITH " + BEATS + "SELECT clip_id, beat_s FROM bt QUALIFY (row_number() OVER (PARTITION BY clip_id ORDER BY beat_s) - 1) % 3 = 0")
def strided_beats(spark, d):
    return B.strided(beats(spark, d), 3).select("clip_id", "beat_s")


def _window_sql(length: str, hop: str) -> str:
    return "WITH " + CLIPS + "," + _DUR + f", w AS (SELECT clip_id, end_s, unnest(range(CAST(ceil(end_s / {hop}) AS BIGINT))) AS i FROM du WHERE end_s > 0) SELECT clip_id, CAST(i AS INTEGER) AS i, round(i * {hop}, 6) AS start_s, round(least(i * {hop} + {length}, end_s), 6) AS end_s FROM w"


def _windows(spark, d, length, hop):
    return B.windows(_durations(spark, d), length, hop).select("clip_id", "i", F.round("start", 6).alias("start_s"), F.round("end", 6).alias("end_s"))


@query(_window_sql("20.0::DOUBLE", "10.0::DOUBLE"))
def sliding_chunks(spark, d):
    return _windows(spark, d, 20.0, 10.0)


@query(_window_sql("10.0::DOUBLE", "10.0::DOUBLE"))
def tumbling_chunks(spark, d):
    return _windows(spark, d, 10.0, 10.0)


@query(GRID + "," + BEATS + f", sp AS (SELECT clip_id, min({_TOK}) AS lo, max({_TOK}) AS hi FROM bt GROUP BY 1) SELECT clip_id, codebook, t FROM g JOIN sp USING (clip_id) WHERE t >= lo AND t < hi")
def snap_to_beats(spark, d):
    return B.snap(token_grid(spark, d), beats(spark, d), scalar.seconds_to_tokens(F.col("beat_s"), RATE, HOP)).select(*CELL)


@query("SELECT date_trunc('minute', ts) AS minute, CAST(count(*) AS BIGINT) AS n, round(median(value), 6) AS middle FROM events GROUP BY 1")
def event_windows(spark, d):
    """Tumbling one-minute windows of the event stream."""
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("minute", F.col("ts")).alias("minute")).agg(F.count(F.lit(1)).alias("n"), F.round(F.median("value"), 6).alias("middle"))


@query("WITH " + BEATS + "SELECT clip_id, CAST(count(*) AS BIGINT) AS beats, CAST(count(CASE WHEN is_downbeat THEN 1 END) AS BIGINT) AS downbeats FROM bt GROUP BY 1")
def beats_json_roundtrip(spark, d):
    """Beat documents written as JSON files and read again, counted."""
    from gridloom.sources import sinks

    from .io_queries import _folder

    folder = _folder(spark, "beats")
    sinks.write_documents(B.beats_json(beats(spark, d)), folder)
    back = spark.read.schema("clip_id bigint, part bigint, beats array<double>, downbeats array<double>").json(folder)
    return back.groupBy("clip_id").agg(F.sum(F.size("beats")).alias("beats"), F.sum(F.size("downbeats")).alias("downbeats"))
