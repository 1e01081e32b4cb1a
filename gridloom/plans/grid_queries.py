"""Whole-grid operations, levels, attention and nested state as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import maps, scalar
from gridloom.functions.rng import uniform
from gridloom.operators import conditions, grids
from gridloom.operators import masks as M
from gridloom.sources.grid import table, token_grid

from .registry import CELL, GRID, query, u


@query(GRID + "SELECT clip_id, codebook, t, code FROM g UNION ALL SELECT clip_id, codebook, CAST(t + steps AS INTEGER), code FROM g")
def concat_time(spark, d):
    """Each clip behind itself."""
    g = token_grid(spark, d)
    return grids.concat_time(g, g)


@query(GRID + "SELECT clip_id, CAST(codebook + 4 AS INTEGER) AS codebook, t, code FROM g UNION ALL SELECT clip_id, codebook, t, code FROM g")
def concat_codebooks(spark, d):
    g = token_grid(spark, d)
    return grids.concat_codebooks(g, g, 4)


@query(GRID + ", r AS (SELECT *, unnest([0, 1, 2]) AS k FROM g) SELECT clip_id, codebook, CAST(t * 3 + k AS INTEGER) AS t, code FROM r WHERE t * 3 + k < steps")
def repeat_steps(spark, d):
    return grids.repeat_steps(token_grid(spark, d), 3).select(*CELL, "code")


@query(GRID + ", e AS (SELECT DISTINCT clip_id, codebook, steps FROM g), p AS (SELECT clip_id, codebook, unnest(range(steps, CAST(ceil(steps / 64.0) * 64 AS BIGINT))) AS t FROM e) SELECT clip_id, codebook, CAST(t AS INTEGER) AS t, code FROM g UNION ALL SELECT clip_id, codebook, CAST(t AS INTEGER), 0 FROM p")
def pad_to_multiple(spark, d):
    return grids.pad_cells(token_grid(spark, d), 64).select(*CELL, "code")


@query(GRID + ", c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS condition, clip_id, codebook, t, steps FROM g" for n in ("baseline", "inpaint_0.5", "inpaint_1.0", "inpaint_2.0")) + ") SELECT condition, CAST(count(*) AS BIGINT) AS cells FROM c WHERE NOT contains(condition, 'inpaint') OR (t >= floor(CAST(split_part(condition, '_', -1) AS DOUBLE) * 57) AND t < steps - floor(CAST(split_part(condition, '_', -1) AS DOUBLE) * 57)) GROUP BY 1")
def trim_context(spark, d):
    """Cells of a suite without the context that its conditions name."""
    g = token_grid(spark, d)
    rows = conditions.run(g, "inpaint").join(g.select("clip_id", "steps").distinct(), "clip_id")
    return grids.trim_context(rows, "condition", 57.0).groupBy("condition").agg(F.count(F.lit(1)).alias("cells"))


@query(GRID + "SELECT clip_id, codebook, t, CASE WHEN t < CAST(floor(steps * 0.25) AS INTEGER) THEN 0 ELSE 1 END AS m_prefix, CASE WHEN t >= steps - CAST(floor(steps * 0.25) AS INTEGER) THEN 0 ELSE 1 END AS m_suffix FROM g")
def imputation_masks(spark, d):
    """Masks that keep the first, and the last, quarter of each clip."""
    quarter = F.floor(F.col("steps") * 0.25).cast("int")
    return token_grid(spark, d).select(*CELL, F.when(F.col("t") < quarter, 0).otherwise(1).alias("m_prefix"), F.when(F.col("t") >= F.col("steps") - quarter, 0).otherwise(1).alias("m_suffix"))


@query(GRID + ", p AS (SELECT clip_id, t // 32 AS part, round(avg(code), 6) AS level FROM g WHERE codebook = 0 GROUP BY 1, 2), b AS (SELECT * FROM p WHERE level >= 400 QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY level DESC, part) = 1) SELECT clip_id, CAST(part * 32 AS BIGINT) AS start, level FROM b")
def salient_excerpt(spark, d):
    """The loudest 32 steps of every clip, the first codebook standing in for levels."""
    return grids.salient_excerpt(token_grid(spark, d).filter("codebook = 0"), "clip_id", "t", "code", 32, 400.0)


@query("SELECT vec_id, round(10 * log10(list_avg(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))), 6) AS level FROM embeddings")
def rms_level(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(grids.rms_level(F.col("embedding").cast("array<double>")), 6).alias("level"))


_ATT = f"""WITH e AS (SELECT vec_id // 8 AS g, vec_id % 8 AS i, embedding[1:8] AS vec, embedding[9:10] AS value FROM embeddings),
s AS (SELECT q.g, q.i AS q, k.i AS k, k.value, list_dot_product(CAST(q.vec AS DOUBLE[]), CAST(k.vec AS DOUBLE[])) / sqrt(8.0) + {u('bias', '(k.i - q.i)')} AS s FROM e q JOIN e k USING (g)),
w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY g, q)) AS x FROM s), p AS (SELECT *, x / sum(x) OVER (PARTITION BY g, q) AS p FROM w),
l AS (SELECT g, q, p, unnest([0, 1]) AS dim, CAST(unnest(value) AS DOUBLE) AS v FROM p)
SELECT CAST(g AS BIGINT) AS g, CAST(q AS BIGINT) AS q, CAST(dim AS INTEGER) AS dim, round(sum(p * v), 6) AS value FROM l GROUP BY 1, 2, 3"""


@query(_ATT)
def attention(spark, d):
    """Attention with a relative-position bias within groups of eight vectors."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).cast("bigint").alias("g"), (F.col("vec_id") % 8).alias("i"), F.col("embedding").cast("array<double>").alias("e"))
    q = e.select("g", F.col("i").alias("q"), F.slice("e", 1, 8).alias("vec"))
    k = e.select("g", F.col("i").alias("k"), F.slice("e", 1, 8).alias("vec"), F.slice("e", 9, 2).alias("value"))
    return grids.attention(q, k, "g", uniform("bias", F.col("k") - F.col("q"))).select("g", "q", "dim", F.round("value", 6).alias("value"))


@query(f"WITH b AS (SELECT unnest(range(32)) AS bucket), w AS (SELECT bucket, {u('bias', 'bucket')} AS bias FROM b), s AS (SELECT unnest(range(-150, 151)) AS distance), k AS (SELECT distance, CAST(CASE WHEN distance > 0 THEN 16 ELSE 0 END + CASE WHEN abs(distance) < 8 THEN abs(distance) ELSE least(15, 8 + floor(ln(greatest(abs(distance), 1) / 8.0) / ln(128 / 8.0) * 8)) END AS INTEGER) AS bucket FROM s) SELECT distance, round(bias, 6) AS bias FROM k JOIN w USING (bucket)")
def position_bias(spark, d):
    """The learnt bias of a distance's bucket, looked up."""
    w = spark.range(32).select(F.col("id").cast("int").alias("bucket"), uniform("bias", "id").alias("bias"))
    return spark.range(-150, 151).select(F.col("id").alias("distance"), scalar.relative_bucket(F.col("id")).alias("bucket")).join(w, "bucket").select("distance", F.round("bias", 6).alias("bias"))


@query("SELECT event_id, event_id + 1 AS step, 0.5::DOUBLE AS factor, 3 AS keys FROM events")
def state_surgery(spark, d):
    """Nested state edited by key: a value set, one added, one renamed, nulls dropped."""
    e = table(spark, d, "events")
    state = F.create_map(F.lit("steps"), F.col("event_id").cast("double"), F.lit("factor"), F.lit(2.0), F.lit("lr"), F.lit(0.1), F.lit("gone"), F.lit(None).cast("double"))
    m = maps.drop_nulls(maps.rename(maps.put(maps.put(state, "factor", F.lit(0.5)), "steps", F.col("event_id") + F.lit(1.0)), "steps", "step"))
    return e.select("event_id", m.alias("m")).select("event_id", F.element_at("m", "step").cast("bigint").alias("step"), F.element_at("m", "factor").alias("factor"), F.size("m").alias("keys"))


@query("SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def key_union(spark, d):
    """Every key that a JSON column has."""
    return table(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("key")).distinct()


@query("SELECT i, round(0.1 + (0.95 - 0.1) * i / 9, 6) AS x FROM (SELECT unnest(range(10)) AS i)")
def linspace(spark, d):
    return spark.range(10).select(F.col("id").alias("i"), F.round(F.lit(0.1) + (0.95 - 0.1) * F.col("id") / 9, 6).alias("x"))


@query(GRID + "SELECT codebook, CAST(count(*) AS BIGINT) AS masked FROM g WHERE t % 4 <> 0 GROUP BY 1")
def mask_broadcast(spark, d):
    """A mask over time alone, spread over all codebooks of the clip by its key."""
    g = token_grid(spark, d)
    line = g.select("clip_id", "t", "steps").distinct().withColumn("m", M.periodic(4, 1))
    return g.join(line.select("clip_id", "t", "m"), ["clip_id", "t"]).filter("m = 1").groupBy("codebook").agg(F.count(F.lit(1)).alias("masked"))
