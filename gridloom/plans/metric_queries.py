"""Evaluation queries over metric rows, distributions and embeddings."""

from __future__ import annotations


from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.functions.rng import uniform
from gridloom.operators import metrics as M
from gridloom.sources.grid import clips, logits, metric_rows, table, token_grid

from .registry import CELL, CLIPS, GRID, LOGITS, METRICS, query, u

_STATS = ", ".join(f"round(avg({m}), 6) AS {m}_mean, CAST(count({m}) AS BIGINT) AS {m}_count, round(stddev_samp({m}), 6) AS {m}_std" for m in ("mel", "frechet"))
# The order and labels in which conditions are shown.
LABELS = {"reconstructed": "Reconstructed", "coarse2fine": "Coarse to fine", "opus_12": "Opus 12 kbps", "inpaint_0.5": "Inpaint 0.5 s", "inpaint_1.0": "Inpaint 1 s", "inpaint_2.0": "Inpaint 2 s", "periodic_7": "Periodic 7", "periodic_13": "Periodic 13"}


@query("WITH " + METRICS + f"SELECT condition, {_STATS} FROM mt GROUP BY condition")
def group_stats(spark, d):
    return M.group_stats(metric_rows(spark, d), ["condition"], ["mel", "frechet"])


_NAMED = "(VALUES " + ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(LABELS.items())) + ") AS n(c, label, place)"


@query("WITH " + METRICS + f"SELECT label AS condition, CAST(place AS INTEGER) AS place, round(avg(mel), 6) AS mel_mean, round(stddev_samp(mel), 6) AS mel_std, round(avg(frechet), 6) AS frechet_mean, round(stddev_samp(frechet), 6) AS frechet_std FROM mt JOIN {_NAMED} ON mt.condition = n.c GROUP BY label, place ORDER BY place")
def ordered_category_stats(spark, d):
    rows = M.relabel(metric_rows(spark, d), "condition", LABELS)
    return M.group_stats(rows, ["condition", "place"], ["mel", "frechet"]).drop("mel_count", "frechet_count").orderBy("place")


_RANK = "WITH " + LOGITS + f""", ow AS (SELECT id, logit AS own FROM lg WHERE k = label),
tr AS (SELECT id, label, count(CASE WHEN logit > own OR (logit = own AND k < label) THEN 1 END) + 1 AS rank, {u('r', 'id')} AS r, {u('m', 'id')} < 0.6 AS masked FROM lg JOIN ow USING (id) GROUP BY id, label)
"""


def _ranked(spark, d):
    return M.target_rank(logits(spark, d)).withColumn("r", uniform("r", "id")).withColumn("masked", uniform("m", "id") < 0.6)


@query(_RANK + """, cells AS (SELECT * FROM (VALUES (0.0, 0.5, '0.0-0.5'), (0.5, 1.0, '0.5-1.0')) AS a(lo, hi, range), (VALUES (1), (25)) AS b(k))
SELECT range, k, masked, round(avg(CASE WHEN rank <= k THEN 1 ELSE 0 END), 6) AS accuracy, CAST(count(*) AS BIGINT) AS n FROM tr JOIN cells ON r >= lo AND r < hi GROUP BY ALL""")
def topk_accuracy_by_range(spark, d):
    return M.accuracy_by_range(_ranked(spark, d), [(0.0, 0.5), (0.5, 1.0)], [1, 25])


@query(_RANK + ", b AS (SELECT id // 32 AS batch, avg(rank) AS x FROM tr GROUP BY 1) SELECT round(avg(x), 6) AS mean_of_means, CAST(count(*) AS BIGINT) AS batches FROM b")
def mean_of_means(spark, d):
    """The unweighted mean of batch means."""
    batches = _ranked(spark, d).groupBy(F.floor(F.col("id") / 32).alias("batch")).agg(F.avg("rank").alias("x"))
    return batches.agg(F.round(F.avg("x"), 6).alias("mean_of_means"), F.count(F.lit(1)).alias("batches"))


@query("WITH " + LOGITS + """, lp AS (SELECT *, logit - max(logit) OVER (PARTITION BY id) - ln(sum(exp(logit)) OVER (PARTITION BY id)) + max(logit) OVER (PARTITION BY id) AS logp FROM lg),
e AS (SELECT id, max(CASE WHEN k = label THEN -logp END) * 0.9 + avg(-logp) * 0.1 AS loss FROM lp GROUP BY id) SELECT round(avg(loss), 6) AS loss, CAST(count(loss) AS BIGINT) AS n FROM e""")
def cross_entropy_smoothed(spark, d):
    return M.smoothed_cross_entropy(logits(spark, d), 0.1)


@query("WITH " + METRICS + """, g AS (SELECT condition, try_cast(file AS BIGINT) AS number, avg(mel) AS mel FROM mt GROUP BY ALL HAVING number IS NOT NULL)
SELECT o.condition, CAST(count(*) AS BIGINT) AS pairs, round(avg(o.mel - b.mel), 6) AS mel_gap FROM g b JOIN g o USING (number) WHERE b.condition = 'reconstructed' AND o.condition <> 'reconstructed' GROUP BY 1""")
def paired_join(spark, d):
    """Each condition's files paired by number with the baseline's."""
    rows = metric_rows(spark, d)
    base, other = M.pair_by_number(rows.filter("condition = 'reconstructed'"), rows.filter("condition <> 'reconstructed'"))
    base = base.groupBy("number").agg(F.avg("mel").alias("base"))
    other = other.groupBy("condition", "number").agg(F.avg("mel").alias("mel"))
    return base.join(other, "number").groupBy("condition").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.col("mel") - F.col("base")), 6).alias("mel_gap"))


@query("WITH " + METRICS + """, g AS (SELECT condition, try_cast(file AS BIGINT) AS number, avg(mel) AS mel FROM mt GROUP BY ALL HAVING number IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY number) AS place FROM g)
SELECT o.condition, CAST(count(*) AS BIGINT) AS pairs, CAST(count(CASE WHEN o.number = b.number THEN 1 END) AS BIGINT) AS alike, round(avg(o.mel - b.mel), 6) AS mel_gap
FROM p b JOIN p o USING (place) WHERE b.condition = 'reconstructed' AND o.condition <> 'reconstructed' GROUP BY 1""")
def positional_pairs(spark, d):
    """The i-th file of each condition with the i-th of the baseline, cut to the shorter side; `alike` counts those of one number."""
    rows = metric_rows(spark, d).withColumn("number", F.expr("try_cast(file AS BIGINT)")).filter("number is not null").groupBy("condition", "number").agg(F.avg("mel").alias("mel"))
    pairs = M.pair_by_place(rows.filter("condition = 'reconstructed'"), rows.filter("condition <> 'reconstructed'"), "number", "condition")
    return pairs.groupBy("condition").agg(F.count(F.lit(1)).alias("pairs"), F.count(F.when(F.col("b.number") == F.col("o.number"), 1)).alias("alike"), F.round(F.avg(F.col("o.mel") - F.col("b.mel")), 6).alias("mel_gap"))


@query("WITH " + METRICS + "," + CLIPS + ", done AS (SELECT file FROM mt GROUP BY file HAVING count(DISTINCT condition) >= 10) SELECT clip_id FROM cl WHERE CAST(clip_id AS VARCHAR) NOT IN (SELECT file FROM done)")
def resume_anti_join(spark, d):
    """Clips that ten conditions have not been written for."""
    done = M.fully_done(metric_rows(spark, d), "file", "condition", 10)
    return clips(spark, d).select("clip_id", F.col("clip_id").cast("string").alias("file")).join(done, "file", "left_anti").select("clip_id")


@query("WITH " + METRICS + "SELECT condition FROM (SELECT DISTINCT condition FROM mt) WHERE condition <> 'reconstructed'")
def condition_discovery(spark, d):
    return metric_rows(spark, d).select("condition").distinct().filter("condition <> 'reconstructed'")


@query("WITH " + METRICS + ", b AS (SELECT condition, avg(frechet) AS group_frechet FROM mt GROUP BY 1) SELECT condition, file, round(mel, 6) AS mel, round(group_frechet, 6) AS group_frechet FROM mt JOIN b USING (condition)")
def group_score_attached(spark, d):
    """A group's score on each of its rows."""
    rows = metric_rows(spark, d)
    return rows.join(rows.groupBy("condition").agg(F.avg("frechet").alias("g")), "condition").select("condition", "file", F.round("mel", 6).alias("mel"), F.round("g", 6).alias("group_frechet"))


_SETS = "WITH " + LOGITS + ", s AS (SELECT k, label < 5 AS a, avg(logit) AS mu, var_samp(logit) AS v FROM lg GROUP BY ALL)"


@query(_SETS + "SELECT round(sum(pow(x.mu - y.mu, 2) + x.v + y.v - 2 * sqrt(x.v * y.v)), 6) AS distance FROM s x JOIN s y USING (k) WHERE x.a AND NOT y.a")
def frechet_diag(spark, d):
    """Fréchet distance of two sets under diagonal covariances."""
    rows = logits(spark, d).groupBy("k", (F.col("label") < 5).alias("a")).agg(F.avg("logit").alias("mu"), F.var_samp("logit").alias("v"))
    x, y = rows.filter("a").select("k", F.col("mu").alias("m1"), F.col("v").alias("v1")), rows.filter("not a").select("k", F.col("mu").alias("m2"), F.col("v").alias("v2"))
    each = F.pow(F.col("m1") - F.col("m2"), F.lit(2.0)) + F.col("v1") + F.col("v2") - F.sqrt(F.col("v1") * F.col("v2")) * 2
    return x.join(y, "k").agg(F.round(F.sum(each), 6).alias("distance"))


@query()
def frechet_full(spark, d):
    """Fréchet distance with full covariances; tested against a numpy restatement."""
    e = table(spark, d, "embeddings")
    return M.frechet(e.filter("label < 5"), e.filter("label >= 5"), "embedding", 64)


_USABLE = "embedding IS NOT NULL AND len(embedding) = 4 AND len(list_filter(embedding, lambda r: len(r) = 16)) = 4"


@query(f"WITH e AS (SELECT emb_id, any_value(embedding) AS embedding FROM genre_embeddings WHERE emb_id IS NOT NULL AND {_USABLE} GROUP BY 1), l AS (SELECT emb_id, unnest(embedding) AS layer FROM e), x AS (SELECT emb_id, unnest(range(16)) AS dim, CAST(unnest(layer) AS DOUBLE) AS v FROM l) SELECT emb_id, CAST(dim AS INTEGER) AS dim, round(avg(v), 6) AS value FROM x GROUP BY 1, 2")
def mean_pool(spark, d):
    """The mean over layers of every record, one value a dimension."""
    whole = (F.size("embedding") == 4) & F.forall("embedding", lambda r: F.coalesce(F.size(r), F.lit(-1)) == 16)
    rows = table(spark, d, "genre_embeddings").filter(F.col("emb_id").isNotNull() & whole).groupBy("emb_id").agg(F.first("embedding").alias("embedding"))
    return M.mean_pool(rows, "emb_id", "embedding")


@query("WITH " + LOGITS + f", w AS (SELECT k, o.out, {u('w', 'k', 'o.out')} - 0.5 AS w FROM (SELECT unnest(range(64)) AS k), (SELECT unnest(range(8)) AS out) o) SELECT id, CAST(out AS INTEGER) AS out, round(sum(logit * w), 6) AS value FROM lg JOIN w USING (k) GROUP BY 1, 2")
def matmul_join(spark, d):
    """A dense projection as a join with its weights and a sum."""
    w = spark.range(64).select(F.col("id").cast("int").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("out")).withColumn("w", uniform("w", "k", "out") - 0.5)
    return M.project(logits(spark, d).select("id", "k", F.col("logit").alias("x")), w, "id").select("id", "out", F.round("value", 6).alias("value"))


@query("WITH " + LOGITS + "SELECT id, k, round(logit / sqrt(avg(logit * logit) OVER (PARTITION BY id) + 1e-6), 6) AS value FROM lg")
def rms_norm(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), M.rms_norm(F.col("embedding").cast("array<double>")).alias("x"))
    return e.select("id", F.posexplode("x").alias("k", "v")).select("id", "k", F.round("v", 6).alias("value"))


@query("""WITH s AS (SELECT unnest(range(-300, 301)) AS distance)
SELECT distance, CAST(CASE WHEN distance > 0 THEN 16 ELSE 0 END + CASE WHEN abs(distance) < 8 THEN abs(distance) ELSE least(15, 8 + floor(ln(greatest(abs(distance), 1) / 8.0) / ln(128 / 8.0) * 8)) END AS INTEGER) AS bucket FROM s""")
def relative_bucket(spark, d):
    return spark.range(-300, 301).select(F.col("id").alias("distance"), scalar.relative_bucket(F.col("id")).alias("bucket"))


@query("WITH " + LOGITS + f"""SELECT id, k, round(greatest(logit, 0), 6) AS relu, round(0.5 * logit * (1 + tanh(sqrt(2 / pi()) * (logit + 0.044715 * pow(logit, 3)))), 6) AS gelu,
round(logit + pow(sin(logit * 1.5), 2) / (1.5 + 1e-9), 6) AS snake, round(logit * 1.1 + 0.2, 6) AS film, round(logit * 0.5 * logit * (1 + tanh(sqrt(2 / pi()) * (logit + 0.044715 * pow(logit, 3)))), 6) AS gated FROM lg""")
def activations(spark, d):
    x = F.col("logit")
    gelu = scalar.activation("gelu")(x)
    return logits(spark, d).select("id", "k", F.round(scalar.activation("relu")(x), 6).alias("relu"), F.round(gelu, 6).alias("gelu"), F.round(scalar.snake(x, 1.5), 6).alias("snake"), F.round(scalar.film(x, F.lit(1.1), F.lit(0.2)), 6).alias("film"), F.round(x * gelu, 6).alias("gated"))


@query(f"WITH s AS (SELECT unnest(range(1, 37)) AS step) SELECT step, round(sin(step / 36.0 * 10000 * exp(-ln(10000) / 7 * 2)), 6) AS c2, round(cos(step / 36.0 * 10000 * exp(-ln(10000) / 7 * 3)), 6) AS c11 FROM s")
def schedule_embedding(spark, d):
    """Two channels of the sinusoidal embedding of a schedule position."""
    r = F.col("id") / F.lit(36.0)
    return spark.range(1, 37).select(F.col("id").alias("step"), F.round(scalar.sinusoid(r, 2, 16), 6).alias("c2"), F.round(scalar.sinusoid(r, 11, 16), 6).alias("c11"))


@query(GRID + f", v AS (SELECT b.codebook, c.code, {u('v', 'b.codebook', 'c.code')} AS x FROM (SELECT unnest(range(4)) AS codebook) b, (SELECT unnest(range(1025)) AS code) c) SELECT clip_id, g.codebook, t, round(x, 6) AS x FROM g LEFT JOIN v ON g.codebook = v.codebook AND g.code = v.code")
def codebook_lookup(spark, d):
    """Tokens with their codebook's value; the mask token has a row of its own."""
    v = spark.range(4 * 1025).select((F.col("id") % 4).cast("int").alias("codebook"), F.floor(F.col("id") / 4).cast("int").alias("code")).withColumn("x", uniform("v", "codebook", "code"))
    return M.embed_codes(token_grid(spark, d), v).select(*CELL, F.round("x", 6).alias("x"))


@query()
def pca_projection(spark, d):
    """The vectors on their first two principal components, signs fixed by the largest loading."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
    out = PCA(k=2, inputCol="x", outputCol="p").fit(rows).transform(rows).select("vec_id", vector_to_array("p").alias("p"))
    return out.select("vec_id", F.round(F.col("p")[0], 6).alias("c1"), F.round(F.col("p")[1], 6).alias("c2"))


@query("WITH s AS (SELECT unnest(range(1, 15)) AS codebooks) SELECT codebooks, round(44100 / 768.0 * (10 * codebooks / 1), 6) AS bits FROM s")
def bitrates(spark, d):
    return spark.range(1, 15).select(F.col("id").alias("codebooks"), F.round(scalar.bitrate(44100, 768, F.col("id")), 6).alias("bits"))


@query("WITH " + LOGITS + "SELECT label, k, round(max(logit), 6) AS high, round(min(logit), 6) AS low, round(median(logit), 6) AS middle FROM lg GROUP BY 1, 2")
def aggregator_registry(spark, d):
    """The named aggregates over one feature table."""
    from gridloom.operators.beats import AGGREGATES

    return logits(spark, d).groupBy("label", "k").agg(F.round(AGGREGATES["max"]("logit"), 6).alias("high"), F.round(AGGREGATES["min"]("logit"), 6).alias("low"), F.round(AGGREGATES["median"]("logit"), 6).alias("middle"))
