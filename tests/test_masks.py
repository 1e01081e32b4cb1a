"""Masks on hand-checked grids, their algebra, and their borders."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.operators import masks as M
from gridloom.sources.grid import clean_beats, clean_grid, with_extent


def grid(spark, steps, codebooks=1, clip=1):
    return with_extent(spark.createDataFrame([(clip, c, t, 7) for c in range(codebooks) for t in range(steps)], "clip_id bigint, codebook int, t int, code int"))


def line(df, m=None):
    rows = (df.withColumn("m", m) if m is not None else df).orderBy("codebook", "t").collect()
    return " ".join(str(r.m) for r in rows)


CASES = [
    (6, ("inpaint", 2, 1), "0 0 1 1 1 0"), (4, ("inpaint", 0, 0), "1 1 1 1"), (4, ("inpaint", 9, 0), "0 0 0 0"),
    (10, ("periodic", 4, 1, 0), "0 1 1 1 0 1 1 1 0 1"), (10, ("periodic", 4, 2, 0), "0 0 1 0 0 0 1 0 0 0"), (10, ("periodic", 4, 3, 0), "0 0 1 0 0 0 1 0 0 0"),
    (10, ("periodic", 4, 1, 1), "1 0 1 1 1 0 1 1 1 0"), (5, ("periodic", 0, 3, 2), "1 1 1 1 1"), (4, ("periodic", 1, 1, 0), "0 0 0 0"),
]


@pytest.mark.parametrize("steps, call, want", CASES)
def test_hand_checked(spark, steps, call, want):
    assert line(grid(spark, steps), getattr(M, call[0])(*call[1:])) == want


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 24), st.integers(1, 9), st.integers(1, 9), st.integers(0, 5))
def test_periodic_equals_stamping(spark, steps, period, width, roll):
    kept = {t for j in range(0, steps, period) for t in range(j - width // 2, j + width // 2 + 1) if 0 <= t < steps}
    naive = [0 if t in kept else 1 for t in range(steps)]
    rolled = [naive[(t - roll) % steps] for t in range(steps)]
    assert line(grid(spark, steps), M.periodic(period, width, roll)) == " ".join(map(str, rolled))


def test_algebra(spark):
    g = grid(spark, 8, 2)
    a, b = M.inpaint(2, 1), M.periodic(3, 1)
    row = g.select(
        *[F.max((x != y).cast("int")).alias(n) for n, x, y in (
            ("commutes", M.both(a, b), M.both(b, a)), ("idempotent", M.either(a, a), a), ("absorbs", M.both(a, M.either(a, b)), a),
            ("no_dropout", M.dropout(a, 0.0), a), ("all_dropped", M.dropout(a, 1.0), F.lit(1)), ("applied", M.apply(M.apply(F.col("code"), a, 9), a, 9), M.apply(F.col("code"), a, 9)),
        )]
    ).first()
    assert set(row) == {0}


def test_codebooks(spark):
    g = grid(spark, 1, 4)
    assert line(g, M.codebook_unmask(M.full(), 2)) == "0 0 1 1"
    assert line(g, M.codebook_unmask(M.full(), -1)) == "0 0 0 1"
    assert line(g, M.codebook_unmask(M.full(), None)) == "1 1 1 1"
    assert line(g, M.codebook_mask(M.empty(), 3)) == "0 0 0 1"


def test_onsets(spark):
    g = grid(spark, 10)
    at = lambda *s: spark.createDataFrame([(1, float(x)) for x in s], "clip_id bigint, beat_s double")
    assert line(M.onset_mask(g, at(5), 2, 1, 1)) == "1 1 1 0 0 0 0 1 1 1"
    assert line(M.onset_mask(g, at(1), 3, 1, 1)) == "1 1 1 1 1 1 1 1 1 1"
    assert line(M.onset_mask(g, at(99), 1, 1, 1)) == "1 1 1 1 1 1 1 1 0 0"
    assert line(M.onset_mask(g, at(), 2, 1, 1)) == "0 0 0 0 0 0 0 0 0 0"


def test_beats_and_strides(spark):
    g = grid(spark, 8)
    rows = spark.createDataFrame([(1, 1.0, False), (1, 3.0, True), (1, 5.0, False), (1, 7.0, False)], "clip_id bigint, beat_s double, is_downbeat boolean")
    assert line(M.beat_mask(g, rows, 1, 1, 0.0, 1.0)) == "1 0 1 0 1 0 1 0"
    assert line(M.beat_mask(g, rows, 1, 1, 0.0, 1.0, upbeats=False)) == "1 1 1 0 1 1 1 1"
    assert line(M.beat_mask(g, rows, 1, 1, 0.0, 1.0, downbeats=False, beat_stride=2)) == "1 0 1 1 1 1 1 0"
    assert line(M.beat_mask(g, rows, 1, 1, 0.0, 1.0, invert=False)) == "0 1 0 1 0 1 0 1"
    with pytest.raises(ValueError):
        M.beat_mask(g, rows, 1, 1, beat_stride=0)


def test_dirty_tables(spark):
    rows = [(1, 0, 0, 5), (1, 0, 0, 3), (1, 0, 1, None), (1, 0, 2, -1), (1, 0, 3, 1024), (None, 0, 0, 1), (1, None, 0, 1), (1, 0, -4, 1), (1, 0, None, 1)]
    schema = "clip_id bigint, codebook int, t int, code int"
    got = {(r.t, r.code) for r in clean_grid(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(0, 3), (1, None), (2, None), (3, 1024)}
    assert with_extent(clean_grid(spark.createDataFrame([], schema))).count() == 0
    beats = [(1, 2.0, None), (1, 2.0, True), (1, None, True), (1, float("nan"), True), (None, 1.0, True)]
    assert [tuple(r) for r in clean_beats(spark.createDataFrame(beats, "clip_id bigint, beat_s double, is_downbeat boolean")).collect()] == [(1, 2.0, True)]
