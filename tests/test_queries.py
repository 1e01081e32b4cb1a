"""Every registered query of the core against its SQL, on the smallest tables."""

import pytest
from conftest import same_rows

from gridloom.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, tables, duck):
    same_rows(QUERIES[name](spark, tables), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, tables):
    assert QUERIES[name](spark, tables).count() > 0


def test_generate_leaves_no_mask_and_keeps_conditioning(spark, tables):
    from gridloom.sources.grid import MASK, token_grid

    out = QUERIES["generate_3step"](spark, tables)
    assert out.filter(f"codebook >= 1 and code = {MASK}").count() == 0
    assert out.count() == token_grid(spark, tables).count()


def test_frechet_equals_numpy(spark, tables):
    import numpy as np

    rows = spark.read.parquet(f"{tables}/embeddings.parquet").select("embedding", "label").collect()
    a, b = (np.array([r.embedding for r in rows if (r.label < 5) == side], np.float64) for side in (True, False))
    c1, c2 = np.cov(a.T), np.cov(b.T)
    w = np.linalg.eigvals(c1 @ c2)
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * np.sqrt(np.maximum(w.real, 0)).sum()
    assert QUERIES["frechet_full"](spark, tables).first().distance == pytest.approx(want, abs=1e-4)


def test_wav_roundtrip_takes_every_vector(spark, tables):
    ids = {f"{r.vec_id}.wav" for r in spark.read.parquet(f"{tables}/embeddings.parquet").select("vec_id").collect()}
    rows = QUERIES["wav_roundtrip"](spark, tables).collect()
    assert len(rows) == len(ids) and {r.path for r in rows} == ids
    assert all(r.exact and r.frames == 64 for r in rows)


def test_whole_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
