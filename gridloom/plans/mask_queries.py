"""Mask algebra over the token grids of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import masks as M
from gridloom.sources.grid import HOP, MASK, RATE, beats, clip_steps, token_grid

from .registry import BEATS, CELL, GRID, query, slice_sql, u

_U = lambda salt: u(salt, *CELL)
_ROWS = "SELECT clip_id, codebook, t, CAST({0} AS INTEGER) AS m FROM g"


def _mask(m):
    return lambda spark, d: token_grid(spark, d).select(*CELL, m().cast("int").alias("m"))


def _periodic_sql(period: int, width: int, offset: str = "0") -> str:
    at = f"((((t - {offset}) % steps) + steps) % steps)"
    half = width // 2
    return f"CASE WHEN {at} % {period} <= {half} OR ({period} - {at} % {period} <= {half} AND {at} + {period} - {at} % {period} < steps) THEN 0 ELSE 1 END"


_LINEAR = f"CASE WHEN {_U('linear')} < 0.8 THEN 1 ELSE 0 END"
_INPAINT = "CASE WHEN t < 3 OR t >= steps - 2 THEN 0 ELSE 1 END"
_ROLL = f"CAST(floor({u('roll')} * 7) AS INTEGER)"


@query(GRID + "SELECT clip_id, codebook, t, 1 AS full_m, 0 AS empty_m FROM g")
def mask_full_empty(spark, d):
    return token_grid(spark, d).select(*CELL, M.full().alias("full_m"), M.empty().alias("empty_m"))


query(GRID + _ROWS.format(f"CASE WHEN {_U('random')} < least(1.0, greatest(1e-10, cos(0.6 * pi() / 2))) THEN 1 ELSE 0 END"), "mask_random")(_mask(lambda: M.random(F.lit(0.6))))
query(GRID + _ROWS.format(f"CASE WHEN {_U('linear')} < 0.35 THEN 1 ELSE 0 END"), "mask_linear_random")(_mask(lambda: M.linear_random(F.lit(0.35))))
query(GRID + _ROWS.format(_INPAINT), "mask_inpaint")(_mask(lambda: M.inpaint(3, 2)))
query(GRID + _ROWS.format(_periodic_sql(7, 3)), "mask_periodic")(_mask(lambda: M.periodic(7, 3)))
query(GRID + _ROWS.format(_periodic_sql(7, 1, _ROLL)), "mask_periodic_roll")(_mask(lambda: M.periodic(7, 1, M.roll_offset(7))))
query(GRID + _ROWS.format(_periodic_sql(4, 1)), "mask_time_stretch")(_mask(lambda: M.time_stretch(4)))
query(GRID + _ROWS.format(f"CASE WHEN codebook >= 3 THEN 1 WHEN codebook < 1 THEN 0 ELSE {_LINEAR} END"), "mask_codebook")(_mask(lambda: M.codebook_mask(M.codebook_unmask(M.linear_random(F.lit(0.8)), 1), 3)))
query(GRID + _ROWS.format(f"CASE WHEN ({_INPAINT}) = 0 AND {_U('dropout')} < 0.2 THEN 1 ELSE {_INPAINT} END"), "mask_dropout")(_mask(lambda: M.dropout(M.inpaint(3, 2), 0.2)))


@query(GRID + f"SELECT clip_id, codebook, t, CAST(least({_INPAINT}, {_periodic_sql(7, 3)}) AS INTEGER) AS m_and, CAST(greatest({_INPAINT}, {_periodic_sql(7, 3)}) AS INTEGER) AS m_or FROM g")
def mask_and_or(spark, d):
    a, b = M.inpaint(3, 2), M.periodic(7, 3)
    return token_grid(spark, d).select(*CELL, M.both(a, b).cast("int").alias("m_and"), M.either(a, b).cast("int").alias("m_or"))


@query(GRID + f"SELECT clip_id, codebook, t, CAST(CASE WHEN ({_LINEAR}) = 1 THEN {MASK} ELSE code END AS INTEGER) AS code, CAST(CASE WHEN ({_LINEAR}) = 1 THEN code END AS INTEGER) AS target FROM g")
def mask_apply(spark, d):
    """Masked input and the target that is to be predicted."""
    m = M.linear_random(F.lit(0.8))
    return token_grid(spark, d).select(*CELL, M.apply(F.col("code"), m, MASK).alias("code"), M.target(F.col("code"), m).alias("target"))


@query(GRID + f"SELECT clip_id, codebook, t, CAST(CASE WHEN ({_INPAINT}) = 1 THEN floor({_U('noise')} * 1024) ELSE code END AS INTEGER) AS code FROM g")
def token_noise(spark, d):
    return token_grid(spark, d).select(*CELL, M.noise(F.col("code"), M.inpaint(3, 2), 1024).alias("code"))


_ONSET = f"""
on_pts AS (SELECT DISTINCT clip_id, steps, CAST(greatest(0, least(floor(beat_s * {RATE} / {HOP}), steps - 1)) AS INTEGER) AS o FROM bt JOIN ext USING (clip_id)),
on_st AS (SELECT clip_id, steps, {slice_sql('(o - 2)', 'steps')} AS lo, {slice_sql('(o + 2)', 'steps')} AS hi FROM on_pts),
on_hint AS (SELECT DISTINCT clip_id, unnest(range(lo, hi)) AS t FROM on_st WHERE lo < hi),
on_m AS (SELECT g.clip_id, codebook, g.t, CASE WHEN h.t IS NOT NULL OR g.clip_id NOT IN (SELECT clip_id FROM on_pts) THEN 0 ELSE 1 END AS m FROM g LEFT JOIN on_hint h ON g.clip_id = h.clip_id AND g.t = h.t)
"""


@query(GRID + "," + BEATS + "," + _ONSET + "SELECT clip_id, codebook, t, CAST(m AS INTEGER) AS m FROM on_m")
def mask_onset(spark, d):
    return M.onset_mask(token_grid(spark, d), beats(spark, d), 2, RATE, HOP, extent=clip_steps(spark, d)).select(*CELL, F.col("m").cast("int").alias("m"))


_BEAT = f"""
b_pts AS (SELECT clip_id, steps, beat_s, is_downbeat, CAST(ceil(beat_s * {RATE} / {HOP}) AS INTEGER) AS o FROM bt JOIN ext USING (clip_id)),
b_kind AS (
  SELECT clip_id, steps, beat_s, o, 0 AS kind FROM b_pts p WHERE NOT EXISTS (SELECT 1 FROM b_pts q WHERE q.is_downbeat AND q.clip_id = p.clip_id AND q.o = p.o)
  UNION ALL SELECT clip_id, steps, beat_s, o, 1 FROM b_pts WHERE is_downbeat),
b_rank AS (SELECT *, row_number() OVER (PARTITION BY clip_id, kind ORDER BY beat_s) AS rank FROM b_kind),
b_use AS (SELECT * FROM b_rank WHERE (rank - 1) % (CASE WHEN kind = 0 THEN 2 ELSE 1 END) = 0),
b_st AS (SELECT *, {slice_sql(f'(o - CAST(ceil(0.02 * {RATE} / {HOP}) AS INTEGER))', 'steps')} AS lo, {slice_sql(f'(o + CAST(ceil(0.05 * {RATE} / {HOP}) AS INTEGER))', 'steps')} AS hi FROM b_use),
b_cell AS (SELECT clip_id, kind, rank, unnest(range(lo, hi)) AS t FROM b_st WHERE lo < hi),
b_bit AS (SELECT clip_id, t, arg_max(CASE WHEN {u('beat', 'clip_id', 'kind', 'rank', 't')} < 0.9 THEN 1 ELSE 0 END, kind * 1000000000 + rank) AS bit FROM b_cell GROUP BY 1, 2),
b_m AS (SELECT g.clip_id, codebook, g.t, 1 - coalesce(bit, 0) AS m FROM g LEFT JOIN b_bit b ON g.clip_id = b.clip_id AND g.t = b.t)
"""


def _beat_mask(spark, d, grid, name="m"):
    return M.beat_mask(grid, beats(spark, d), RATE, HOP, 0.02, 0.05, beat_stride=2, p_dropout=0.1, name=name, extent=clip_steps(spark, d))


@query(GRID + "," + BEATS + "," + _BEAT + "SELECT clip_id, codebook, t, CAST(m AS INTEGER) AS m FROM b_m")
def mask_beat(spark, d):
    return _beat_mask(spark, d, token_grid(spark, d)).select(*CELL, F.col("m").cast("int").alias("m"))


_COMPOSED = f"""
c AS (SELECT g.*, least(greatest(least(least({_LINEAR}, {_INPAINT}), {_periodic_sql(7, 1, _ROLL)}), on_m.m), b_m.m) AS m0
  FROM g JOIN on_m USING (clip_id, codebook, t) JOIN b_m USING (clip_id, codebook, t))
SELECT clip_id, codebook, t, CAST(CASE WHEN codebook >= 3 THEN 1 WHEN codebook < 1 THEN 0 WHEN m0 = 0 AND {_U('dropout')} < 0.1 THEN 1 ELSE m0 END AS INTEGER) AS m FROM c
"""


@query(GRID + "," + BEATS + "," + _ONSET + "," + _BEAT + "," + _COMPOSED)
def mask_compose(spark, d):
    rows = M.onset_mask(token_grid(spark, d), beats(spark, d), 2, RATE, HOP, "m_onset", clip_steps(spark, d))
    rows = _beat_mask(spark, d, rows, "m_beat")
    m = M.compose(0.8, 3, 2, 7, 1, 0.1, 1, 3, F.col("m_onset"), F.col("m_beat"))
    return rows.select(*CELL, m.cast("int").alias("m"))


@query(GRID + "," + BEATS + "," + _BEAT + "SELECT clip_id, codebook, t, CAST(least(1, m) AS INTEGER) AS m FROM b_m")
def mask_compose_api(spark, d):
    """The reduced composition: everything masked, and beats."""
    rows = _beat_mask(spark, d, token_grid(spark, d))
    return rows.select(*CELL, M.both(M.linear_random(F.lit(1.0)), F.col("m")).cast("int").alias("m"))


@query(GRID + f"SELECT clip_id, t, coalesce(bool_or(code = {MASK}), false) AS silent FROM g GROUP BY 1, 2")
def silence_frames(spark, d):
    return M.silent_steps(token_grid(spark, d), MASK)


@query(GRID + "SELECT clip_id, CAST(t * codebooks + codebook AS BIGINT) AS pos, CAST(t AS INTEGER) AS t, CAST(codebook AS INTEGER) AS codebook, code FROM g")
def flatten_roundtrip(spark, d):
    flat = token_grid(spark, d).select("clip_id", M.flat_position(F.col("codebooks")).cast("bigint").alias("pos"), "codebooks", "code")
    t, codebook = M.unflatten(F.col("pos"), F.col("codebooks"))
    return flat.select("clip_id", "pos", t.alias("t"), codebook.alias("codebook"), "code")


@query(GRID + f"SELECT codebook, CAST(count(*) AS BIGINT) AS cells, CAST(count(CASE WHEN m = 0 THEN 1 END) AS BIGINT) AS kept, CAST(coalesce(sum(CASE WHEN m = 0 THEN code END), 0) AS BIGINT) AS checksum FROM (SELECT *, least(CASE WHEN t < 2 OR t >= steps - 2 THEN 0 ELSE 1 END, {_periodic_sql(5, 1)}) AS m FROM g) GROUP BY 1")
def kept_tokens(spark, d):
    """How many tokens of each codebook survive prefix, suffix and period: the flagship query."""
    m = M.both(M.inpaint(2, 2), M.periodic(5, 1))
    rows = token_grid(spark, d).withColumn("m", m)
    return rows.groupBy("codebook").agg(F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col("m") == 0, 1)).alias("kept"), F.coalesce(F.sum(F.when(F.col("m") == 0, F.col("code"))), F.lit(0)).alias("checksum"))
