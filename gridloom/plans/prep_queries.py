"""Dataset preparation over the clips, documents and streams of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import scalar, text
from gridloom.functions.rng import uniform
from gridloom.operators import prep as P
from gridloom.sources.grid import clips, table, token_grid

from .registry import CLIPS, GRID, query, u

_STEM = "regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')"
_PAD = "(CASE WHEN length(CAST(i AS VARCHAR)) >= 3 THEN CAST(i AS VARCHAR) ELSE lpad(CAST(i AS VARCHAR), 3, '0') END)"
_CHUNKS = "WITH " + CLIPS + f""",
lo AS (SELECT clip_id, path, duration_ms AS d FROM cl WHERE dbfs > -40 AND NOT isnan(dbfs) AND duration_ms > 0),
ch AS (SELECT clip_id, path, 1 AS i, 0 AS start_ms FROM lo WHERE d < 70000
  UNION ALL SELECT clip_id, path, i, i * 60000 FROM (SELECT *, unnest(range(1, d // 60000 + 1)) AS i FROM lo WHERE d >= 70000) WHERE i * 60000 + 10000 <= d)
"""


@query(_CHUNKS + f"SELECT clip_id, CAST(i AS INTEGER) AS i, CAST(start_ms AS BIGINT) AS start_ms, {_STEM} || '_' || {_PAD} AS name FROM ch")
def chunk_rules(spark, d):
    return P.chunks(clips(spark, d))


@query(_CHUNKS + ", v AS (SELECT *, unnest(range(4)) AS variant FROM ch) SELECT clip_id, CAST(i AS INTEGER) AS i, CAST(variant AS INTEGER) AS variant, " + f"CAST([0.8, 0.9, 1.1, 1.25][CAST(floor({u('ratio', 'clip_id', 'i', 'variant')} * 4) AS INTEGER) + 1] AS DOUBLE) AS ratio FROM v")
def augment_cross(spark, d):
    return P.augmentations(P.chunks(clips(spark, d)), 4, [0.8, 0.9, 1.1, 1.25]).select("clip_id", "i", "variant", "ratio")


@query("WITH " + CLIPS + "SELECT clip_id, round(loudness, 6) AS loudness, dbfs > -40 AND NOT isnan(dbfs) AS audible FROM cl WHERE loudness >= -30 AND NOT isnan(loudness) AND dbfs IS NOT NULL")
def loudness_filter(spark, d):
    rows = clips(spark, d).filter(P.loud_enough() & F.col("dbfs").isNotNull())
    return rows.select("clip_id", F.round("loudness", 6).alias("loudness"), P.not_silent().alias("audible"))


@query("WITH " + CLIPS + "SELECT clip_id, round(peak, 6) AS peak, round(20 * log10(peak), 6) AS peak_db FROM cl WHERE peak < 0.987 AND peak > 0")
def not_normalised(spark, d):
    rows = clips(spark, d).filter(P.below_peak() & (F.col("peak") > 0))
    return rows.select("clip_id", F.round("peak", 6).alias("peak"), F.round(scalar.decibels(F.col("peak")), 6).alias("peak_db"))


@query("WITH " + CLIPS + "SELECT clip_id, CAST(CASE WHEN duration_ms > 0 AND duration_ms < 10000 THEN 10000 // duration_ms + 1 ELSE 1 END AS INTEGER) AS repeats FROM cl")
def loop_repeats(spark, d):
    return clips(spark, d).select("clip_id", P.tiles_needed(F.col("duration_ms")).alias("repeats"))


@query("WITH x AS (SELECT vec_id, list_max(list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE)))) AS peak, embedding FROM embeddings) SELECT vec_id, CAST(k AS INTEGER) AS k, round(v / peak * 0.988, 6) AS v FROM (SELECT vec_id, peak, unnest(range(len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM x)")
def peak_normalise(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", P.peak_normalise(F.col("embedding").cast("array<double>")).alias("x"))
    return rows.select("vec_id", F.posexplode("x").alias("k", "v")).select("vec_id", "k", F.round("v", 6).alias("v"))


@query("WITH t AS (SELECT 'song' || (vec_id // 3) AS base, embedding, 'song' || (vec_id // 3) || '-' || (vec_id % 3) AS name FROM embeddings), f AS (SELECT base, arg_min(len(embedding), name) AS n FROM t GROUP BY 1), e AS (SELECT base, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM t) SELECT base, CAST(i AS INTEGER) AS i, round(sum(v), 6) AS value FROM e JOIN f USING (base) WHERE i < n GROUP BY 1, 2")
def mixdown(spark, d):
    """Tracks that share the name before their last dash, added up."""
    third = F.floor(F.col("vec_id") / 3).cast("bigint")
    t = table(spark, d, "embeddings").select(F.concat(F.lit("song"), third, F.lit("-"), F.col("vec_id") % 3).alias("name"), F.col("embedding").cast("array<double>").alias("x"))
    return P.mixdown(t, "name", "x").select("base", "i", F.round("value", 6).alias("value"))


@query(GRID + ", lv AS (SELECT clip_id, t, min(code) AS level FROM g WHERE codebook = 0 AND code IS NOT NULL GROUP BY 1, 2), s AS (SELECT clip_id, min(t) AS a, max(t) AS b, min(CASE WHEN level >= 512 THEN t END) AS x, max(CASE WHEN level >= 512 THEN t END) AS y FROM lv GROUP BY 1) SELECT clip_id, CAST(coalesce(x - a, b - a + 1) * 10 AS BIGINT) AS lead_ms, CAST(greatest(1, coalesce(b - y, b - a + 1)) * 10 AS BIGINT) AS trail_ms FROM s")
def silence_trim(spark, d):
    """Leading and trailing runs below a level, the first codebook standing in for levels of ten-millisecond steps."""
    levels = token_grid(spark, d).filter("codebook = 0 and code is not null")
    return P.silence_edges(levels, "clip_id", "t", "code", 512)


@query("WITH h AS (SELECT doc_id, CAST(('0x' || substr(md5('42|' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) AS h FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS r, count(*) OVER () AS n FROM h) SELECT doc_id, CASE WHEN r <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r")
def train_test_split(spark, d):
    return P.split_by_hash(table(spark, d, "documents").select("doc_id"), "doc_id", 0.2, 42)


@query("WITH " + CLIPS + "SELECT label, arg_max(path, (duration_ms, path)) AS path FROM (SELECT label, path, coalesce(duration_ms, -1) AS duration_ms FROM cl WHERE label IS NOT NULL AND path IS NOT NULL) GROUP BY 1")
def latest_by_key(spark, d):
    """The path of the greatest value of each label."""
    rows = clips(spark, d).filter("label is not null and path is not null").withColumn("duration_ms", F.coalesce("duration_ms", F.lit(-1)))
    return P.latest(rows, ["label"], "duration_ms", "path")


@query("WITH " + CLIPS + """SELECT regexp_extract(path, '([^/]+)/[^/]*$', 1) AS folder, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '.(\\.[^.]*)$', 1)) AS extension, CAST(count(*) AS BIGINT) AS files
FROM cl WHERE lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '.(\\.[^.]*)$', 1)) IN ('.wav', '.mp3', '.flac', '.aac', '.ogg') GROUP BY 1, 2""")
def folder_labels(spark, d):
    """Files by the folder that labels them and by extension."""
    rows = clips(spark, d).select(text.parent_name(F.col("path")).alias("folder"), text.suffix(F.col("path")).alias("extension"))
    return rows.filter(F.col("extension").isin(".wav", ".mp3", ".flac", ".aac", ".ogg")).groupBy("folder", "extension").agg(F.count(F.lit(1)).alias("files"))


@query("WITH " + CLIPS + f", r AS (SELECT clip_id, path, {u('pick', 'clip_id')} AS x FROM cl WHERE loudness >= -40 AND NOT isnan(loudness)) SELECT clip_id, path FROM r ORDER BY x, clip_id LIMIT 50")
def loader_without_replacement(spark, d):
    """Fifty excerpts in a seeded order, above a loudness cutoff."""
    rows = clips(spark, d).filter(P.loud_enough(least=-40.0)).select("clip_id", "path", uniform("pick", "clip_id").alias("x"))
    return rows.orderBy("x", "clip_id").limit(50).select("clip_id", "path")


@query("WITH " + CLIPS + f""", n AS (SELECT clip_id, sample_rate, row_number() OVER (PARTITION BY sample_rate ORDER BY clip_id) AS rank, count(*) OVER (PARTITION BY sample_rate) AS n FROM cl),
s AS (SELECT draw, CASE WHEN {u('load-source', 'draw')} < 0.7 THEN 44100 ELSE 48000 END AS sample_rate FROM (SELECT unnest(range(500, 1500)) AS draw))
SELECT CAST(draw AS BIGINT) AS draw, CAST(s.sample_rate AS INTEGER) AS sample_rate, clip_id FROM s LEFT JOIN n ON n.sample_rate = s.sample_rate AND n.rank = CAST(floor({u('load', 'draw')} * n.n) AS BIGINT) + 1""")
def loader_weighted(spark, d):
    """Draws 500 to 1 499 of an endless loader over two weighted sources."""
    return P.weighted_loader(clips(spark, d), "sample_rate", "clip_id", {44100: 0.7, 48000: 0.3}, 1000, 500)


@query("WITH " + CLIPS + f", n AS (SELECT clip_id, path, row_number() OVER (ORDER BY clip_id) - 1 AS i, count(*) OVER () AS n FROM cl), s AS (SELECT unnest(range(1000)) AS draw) SELECT CAST(draw AS BIGINT) AS draw, clip_id FROM s JOIN n ON n.i = CAST(floor({u('draw', 'draw')} * n.n) AS BIGINT)")
def loader_with_replacement(spark, d):
    """A thousand draws with replacement."""
    from gridloom.operators.ordered import rank_along

    rows = rank_along(clips(spark, d).select("clip_id", F.lit(1).alias("one")), ["one"], ["clip_id"], 4096.0).select("clip_id", (F.col("rank") - 1).alias("i"))
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    draws = spark.range(1000).select(F.col("id").alias("draw")).crossJoin(F.broadcast(total))  # one row
    return draws.withColumn("i", F.floor(uniform("draw", "draw") * F.col("n"))).join(rows, "i").select("draw", "clip_id")
