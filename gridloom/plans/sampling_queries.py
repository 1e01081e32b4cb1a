"""Sampling from the distributions of the flat vectors, and generation on the grids."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.functions.rng import uniform
from gridloom.operators import sampling as S
from gridloom.sources.grid import MASK, logits, token_grid

from .registry import GRID, LOGITS, query, u

_SOFT = "WITH " + LOGITS + ", mx AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY id)) AS e FROM lg), sm AS (SELECT *, e / sum(e) OVER (PARTITION BY id) AS p FROM mx)"
_GUMBEL = lambda x: f"(-ln(-ln(least(1 - 1e-12, greatest(1e-20, {x})))))"


@query(_SOFT + "SELECT id, k, round(p, 6) AS p FROM sm")
def softmax(spark, d):
    return S.softmax(logits(spark, d)).select("id", "k", F.round("p", 6).alias("p"))


@query("WITH " + LOGITS + "SELECT id, k FROM lg QUALIFY rank() OVER (PARTITION BY id ORDER BY logit DESC) <= 5")
def top_k_filter(spark, d):
    return logits(spark, d).withColumn("keep", S.top_k_keep(5)).filter("keep").select("id", "k")


@query(_SOFT + "SELECT id, k FROM sm QUALIFY coalesce(sum(p) OVER (PARTITION BY id ORDER BY p DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 0.5")
def top_p_filter(spark, d):
    return S.softmax(logits(spark, d)).withColumn("keep", S.top_p_keep(0.5)).filter("keep").select("id", "k")


_TYPICAL = _SOFT + """, en AS (SELECT id, k, p, abs(-ln(p) - sum(-p * ln(p)) OVER (PARTITION BY id)) AS s FROM sm),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, k) AS r, sum(p) OVER (PARTITION BY id ORDER BY s, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM en),
ls AS (SELECT *, least(count(CASE WHEN cum < 0.3 THEN 1 END) OVER (PARTITION BY id), count(*) OVER (PARTITION BY id) - 1) AS last FROM rk)
SELECT id, k FROM ls QUALIFY s <= max(CASE WHEN r = last + 1 THEN s END) OVER (PARTITION BY id) OR r <= 4"""


@query(_TYPICAL)
def typical_filter(spark, d):
    return S.typical(logits(spark, d), 0.3, 4).filter("keep").select("id", "k")


@query("WITH " + LOGITS + f"SELECT id, arg_max(k, logit / 0.8 + {_GUMBEL(u('gumbel', 'id', 'k'))}) AS k FROM lg GROUP BY id")
def gumbel_argmax(spark, d):
    return S.gumbel_argmax(logits(spark, d), 0.8)


@query("WITH " + LOGITS + "SELECT id, k FROM lg QUALIFY row_number() OVER (PARTITION BY id ORDER BY logit DESC, k) = 1")
def argmax_tokens(spark, d):
    return S.argmax(logits(spark, d))


@query(_SOFT + f", c AS (SELECT *, sum(p) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM sm) SELECT id, coalesce(min(CASE WHEN cum > {u('draw', 'id')} THEN k END), max(k)) AS k FROM c GROUP BY id")
def sample_inverse_cdf(spark, d):
    return S.inverse_cdf(S.softmax(logits(spark, d)))


@query("WITH " + LOGITS + f""", tk AS (SELECT * FROM lg QUALIFY rank() OVER (PARTITION BY id ORDER BY logit DESC) <= 20),
mx AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY id)) AS e FROM tk), sm AS (SELECT *, e / sum(e) OVER (PARTITION BY id) AS p FROM mx),
tp AS (SELECT id, k, logit FROM sm QUALIFY coalesce(sum(p) OVER (PARTITION BY id ORDER BY p DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 0.7),
m2 AS (SELECT *, exp(logit / 0.9 - max(logit / 0.9) OVER (PARTITION BY id)) AS e FROM tp), s2 AS (SELECT *, e / sum(e) OVER (PARTITION BY id) AS p FROM m2),
c AS (SELECT *, sum(p) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM s2),
ch AS (SELECT id, coalesce(min(CASE WHEN cum > {u('draw', 'id')} THEN k END), max(k)) AS k FROM c GROUP BY id)
SELECT id, k, round(p, 6) AS p FROM ch JOIN s2 USING (id, k)""")
def sample_from_logits(spark, d):
    """All filters in order, then a draw with its probability."""
    return S.sample(logits(spark, d), temperature=0.9, top_k=20, top_p=0.7).select("id", "k", F.round("p", 6).alias("p"))


@query(_SOFT + f""", cf AS (SELECT id, k, ln(greatest(p, 1e-300)) + 0.7 * {_GUMBEL(u('remask', 'id', 'k'))} AS c FROM sm),
rr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c, k) AS r FROM cf)
SELECT id, k, CASE WHEN c < max(CASE WHEN r = 11 THEN c END) OVER (PARTITION BY id) THEN 1 ELSE 0 END AS m FROM rr""")
def remask_topk(spark, d):
    return S.remask(S.softmax(logits(spark, d)), 10, 0.7, "id", "k").select("id", "k", "m")


@query("""WITH s AS (SELECT unnest(range(1, 37)) AS step)
SELECT step, round(least(1.0, greatest(1e-10, cos(step / 36.0 * pi() / 2))), 6) AS share, round(2 * acos(least(1.0, greatest(1e-10, cos(step / 36.0 * pi() / 2)))) / pi(), 6) AS progress,
CAST(floor(least(1.0, greatest(1e-10, cos(step / 36.0 * pi() / 2))) * 1000 + 1e-9) AS BIGINT) AS left_of_1000, round(10.5 * (1 - step / 36.0), 6) AS temperature, (step - 1) / 36.0 <= 0.5 AS draws FROM s""")
def gamma_schedule(spark, d):
    """Share, its inverse, tokens left of 1000, temperature and whether a step still draws, over 36 steps."""
    r = F.col("step") / F.lit(36.0)
    g = scalar.gamma(r)
    rows = spark.range(1, 37).select(F.col("id").alias("step"))
    return rows.select("step", F.round(g, 6).alias("share"), F.round(scalar.inverse_gamma(g), 6).alias("progress"), F.floor(g * 1000 + 1e-9).cast("bigint").alias("left_of_1000"), F.round((1 - r) * 10.5, 6).alias("temperature"), ((F.col("step") - 1) / F.lit(36.0) <= 0.5).alias("draws"))


def _rounds(keys: str, steps: int, temperature: float, top_k: int, top_p: float, heat: float, cutoff: float) -> str:
    """The rounds of generation in SQL: from the CTE s0(keys, codebook, t, pos, code) to the CTE s{steps}."""
    out, group = [f"n0s AS (SELECT {keys}, count(CASE WHEN code = {MASK} THEN 1 END) AS n0 FROM s0 GROUP BY ALL)"], keys.split(", ")
    for i in range(steps):
        number = lambda at, n: f"CAST(('0x' || substr(h, {at}, {n})) AS BIGINT)"
        draw = u(f"draw{i}", *group, "pos") if i / steps <= cutoff else None
        pick = f"coalesce(min(CASE WHEN cum > {draw} * total THEN r END), max(r))" if draw else "1"
        share = math.cos((i + 1) / steps * math.pi / 2)
        out += [
            f"h{i} AS (SELECT *, md5(concat_ws('|', 'score', {', '.join(f'CAST({k} AS VARCHAR)' for k in [*group, 'pos'])}, '{i}')) AS h FROM s{i} WHERE code = {MASK})",
            f"c{i} AS ({' UNION ALL '.join(f'SELECT {keys}, pos, {j} AS j, CAST(({number(1, 8)} + {163 * j}) % 1024 AS INTEGER) AS k, {number(9 + 4 * j, 4)} * 6 / 65536.0::DOUBLE AS logit FROM h{i}' for j in range(6))})",
            f"r{i} AS (SELECT *, row_number() OVER (PARTITION BY {keys}, pos ORDER BY logit DESC, j) AS r, max(logit) OVER (PARTITION BY {keys}, pos) AS top FROM c{i} QUALIFY r <= {top_k})",
            f"t{i} AS (SELECT *, sum(exp(logit - top)) OVER (PARTITION BY {keys}, pos ORDER BY r) AS cum, sum(exp(logit - top)) OVER (PARTITION BY {keys}, pos) AS total FROM r{i})",
            f"p{i} AS (SELECT * EXCLUDE (cum, total) FROM t{i} QUALIFY r = 1 OR lag(cum) OVER (PARTITION BY {keys}, pos ORDER BY r) <= {top_p} * total)",
            f"q{i} AS (SELECT *, exp((logit - top) / {heat}) AS e, sum(exp((logit - top) / {heat})) OVER (PARTITION BY {keys}, pos ORDER BY r) AS cum, sum(exp((logit - top) / {heat})) OVER (PARTITION BY {keys}, pos) AS total FROM p{i})",
            f"w{i} AS (SELECT {keys}, pos, {pick} AS r FROM q{i} GROUP BY {keys}, pos)",
            f"v{i} AS (SELECT {keys}, pos, k, e / total AS p FROM q{i} JOIN w{i} USING ({keys}, pos, r))",
            f"f{i} AS (SELECT s.*, v.k IS NOT NULL AS unknown, coalesce(v.k, s.code) AS value, ln(greatest(v.p, 1e-300)) + {temperature * (1 - (i + 1) / steps)!r} * {_GUMBEL(u(f'remask{i}', *group, 'pos'))} AS c FROM s{i} s LEFT JOIN v{i} v USING ({keys}, pos))",
            f"g{i} AS (SELECT f.*, n0, row_number() OVER (PARTITION BY {keys} ORDER BY unknown DESC, c, pos) AS rk, count(CASE WHEN unknown THEN 1 END) OVER (PARTITION BY {keys}) AS lft FROM f{i} f JOIN n0s USING ({keys}))",
            f"k{i} AS (SELECT *, max(CASE WHEN unknown AND rk = greatest(1, least(lft - 1, CAST(floor({share!r}::DOUBLE * n0) AS BIGINT))) + 1 THEN c END) OVER (PARTITION BY {keys}) AS cut FROM g{i})",
            f"s{i + 1} AS (SELECT {keys}, codebook, t, pos, " + ("value" if i == steps - 1 else f"CASE WHEN unknown AND (cut IS NULL OR c < cut) THEN {MASK} ELSE value END") + f" AS code FROM k{i})",
        ]
    return ", ".join(out)


_MASKED = f"CASE WHEN t < 3 OR t >= steps - 2 THEN coalesce(code, {MASK}) ELSE {MASK} END"
_START = f", s0 AS (SELECT clip_id, codebook, t, t * (codebooks - 1) + codebook - 1 AS pos, {_MASKED} AS code FROM g WHERE codebook >= 1), "
_SAMPLER = dict(sampling_temperature=0.9, top_k=4, top_p=0.9, sample_cutoff=0.5)


def _start(spark, d):
    from gridloom.operators import masks as M
    from gridloom.plans.shared import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return token_grid(spark, d), M.inpaint(3, 2)


@query(GRID + _START + _rounds("clip_id", 3, 10.5, 4, 0.9, 0.9, 0.5) + f" SELECT clip_id, codebook, t, CAST(code AS INTEGER) AS code FROM s3 UNION ALL SELECT clip_id, codebook, t, {_MASKED} FROM g WHERE codebook < 1")
def generate_3step(spark, d):
    """Three rounds of scoring, sampling and re-masking of the cells that a mask hides; no mask token is left where it was."""
    from gridloom.operators import masks as M

    grid, mask = _start(spark, d)
    return S.generate(grid.withColumn("code", M.apply(F.coalesce("code", F.lit(MASK)), mask, MASK)), S.hash_scorer(1024), 3, MASK, conditioning=1, **_SAMPLER)


_VAMP = _START.replace("t * (codebooks - 1) + codebook - 1", "t * least(codebooks, 3) + codebook").replace("codebook >= 1", "codebook < 3")


@query(GRID + _VAMP + _rounds("clip_id", 2, 10.5, 4, 0.9, 0.9, 0.5) + f" SELECT clip_id, codebook, t, CAST(code AS INTEGER) AS code, 'vamp' AS part FROM s2 UNION ALL SELECT clip_id, codebook, t, code, 'vamp' FROM g WHERE codebook >= 3 UNION ALL SELECT clip_id, codebook, t, CASE WHEN t < 3 OR t >= steps - 2 THEN code ELSE {MASK} END, 'mask' FROM g WHERE codebook < 3")
def coarse_vamp(spark, d):
    """The first three codebooks generated anew under a mask, the others put back, and the masked codebooks besides."""
    grid, mask = _start(spark, d)
    made, masked = S.coarse_vamp(grid, mask, lambda g: S.generate(g, S.hash_scorer(1024), 2, MASK, **_SAMPLER), 3, MASK)
    return made.withColumn("part", F.lit("vamp")).unionByName(masked.withColumn("part", F.lit("mask")))


_CHUNKS = """, cells AS (SELECT clip_id, steps, unnest(range(CAST(ceil(steps / 64.0) * 64 AS BIGINT))) AS t FROM (SELECT DISTINCT clip_id, steps FROM g)),
full_ AS (SELECT c.*, b.codebook FROM cells c, (SELECT unnest(range(6)) AS codebook) b),
fine AS (SELECT f.clip_id, CAST(f.t // 64 AS INTEGER) AS chunk, CAST(f.codebook AS INTEGER) AS codebook, CAST(f.t % 64 AS INTEGER) AS t,
CAST(CASE WHEN f.t >= f.steps THEN 0 WHEN f.codebook >= 4 THEN 1024 ELSE coalesce(g.code, 0) END AS INTEGER) AS code
FROM full_ f LEFT JOIN g ON f.clip_id = g.clip_id AND f.t = g.t AND f.codebook = g.codebook),
s0 AS (SELECT clip_id, chunk, codebook, t, t * 2 + codebook - 4 AS pos, code FROM fine WHERE codebook >= 4), """


@query(GRID + _CHUNKS + _rounds("clip_id, chunk", 2, 10.5, 4, 0.9, 0.9, 0.5) + " SELECT clip_id, codebook, CAST(chunk * 64 + t AS INTEGER) AS t, CAST(code AS INTEGER) AS code FROM (SELECT clip_id, chunk, codebook, t, code FROM s2 UNION ALL SELECT clip_id, chunk, codebook, t, code FROM fine WHERE codebook < 4) JOIN (SELECT DISTINCT clip_id, steps FROM g) USING (clip_id) WHERE chunk * 64 + t < steps")
def coarse_to_fine(spark, d):
    """Two finer codebooks generated chunk by chunk, laid end to end and cut to the clip's steps."""
    grid, _ = _start(spark, d)
    return S.coarse_to_fine(grid, S.hash_scorer(1024, ("clip_id", "chunk")), 2, 64, 6, 4, MASK, **_SAMPLER)


_ONE = GRID + f""", z AS (SELECT clip_id, codebook, t, t * codebooks + codebook AS pos, CASE WHEN codebook < 1 THEN coalesce(code, {MASK}) ELSE {MASK} END AS code FROM g),
h AS (SELECT *, md5(concat_ws('|', 'score', CAST(clip_id AS VARCHAR), CAST(pos AS VARCHAR), '0')) AS h FROM z),
l AS (SELECT *, [{', '.join(f"CAST(('0x' || substr(h, {9 + 4 * j}, 4)) AS BIGINT)" for j in range(6))}] AS x FROM h)
SELECT clip_id, codebook, t, CAST(CASE WHEN code = {MASK} THEN (CAST(('0x' || substr(h, 1, 8)) AS BIGINT) + 163 * (list_position(x, list_max(x)) - 1)) % 1024 ELSE code END AS INTEGER) AS code FROM l"""


@query(_ONE)
def one_step(spark, d):
    """All codebooks but the first predicted at once."""
    grid = token_grid(spark, d).withColumn("code", F.when(F.col("codebook") >= 1, MASK).otherwise(F.col("code")))
    return S.one_step(grid, S.hash_scorer(1024), MASK)


@query(GRID + """, cells AS (SELECT clip_id, steps, unnest(range(CAST(ceil(steps / 64.0) * 64 AS BIGINT))) AS t FROM (SELECT DISTINCT clip_id, steps FROM g)),
full_ AS (SELECT c.*, b.codebook FROM cells c, (SELECT unnest(range(6)) AS codebook) b)
SELECT f.clip_id, CAST(f.t // 64 AS INTEGER) AS chunk, CAST(f.codebook AS INTEGER) AS codebook, CAST(f.t % 64 AS INTEGER) AS step,
CAST(CASE WHEN f.t >= f.steps THEN 0 WHEN f.codebook >= 4 THEN 1024 ELSE coalesce(g.code, 0) END AS INTEGER) AS code, CAST(CASE WHEN f.codebook < 4 OR f.t >= f.steps THEN 0 ELSE 1 END AS INTEGER) AS m
FROM full_ f LEFT JOIN g ON f.clip_id = g.clip_id AND f.t = g.t AND f.codebook = g.codebook""")
def coarse_to_fine_chunks(spark, d):
    return S.fine_chunks(token_grid(spark, d), 64, 6, 4, MASK)


@query(f"SELECT event_id, CAST(floor({u('noise', 'event_id')} * 1024) AS INTEGER) AS code, round({u('r', 'event_id')} * 0.85 + 0.1, 6) AS r, {u('flip', 'event_id')} < 0.3 AS flip FROM events")
def random_draws(spark, d):
    """Noise tokens, a uniform range and a coin from hashed uniforms."""
    from gridloom.functions import rng
    from gridloom.sources.grid import table

    return table(spark, d, "events").select("event_id", F.floor(uniform("noise", "event_id") * 1024).cast("int").alias("code"), F.round(rng.uniform_between(0.1, 0.95, "r", "event_id"), 6).alias("r"), rng.coin(0.3, "flip", "event_id").alias("flip"))


@query("SELECT event_id, list_sum(list_transform(range(16), lambda b: ((event_id // CAST(pow(2, b) AS BIGINT)) % 2) / pow(2, b + 1))) AS r FROM events")
def low_discrepancy(spark, d):
    """The base-2 radical inverse of row numbers, as ratios for masks."""
    from gridloom.functions import rng
    from gridloom.sources.grid import table

    return table(spark, d, "events").select("event_id", rng.van_der_corput(F.col("event_id")).alias("r"))
