"""Deterministic uniforms: a hash of a salt and keys, so every run, engine and partitioning draws the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(salt: str, *keys: Column | str) -> Column:
    """A number in [0, 1) from the first 32 bits of md5(salt|key|...); null keys are skipped."""
    cols = [F.lit(salt)] + [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_between(lo: float, hi: float, salt: str, *keys) -> Column:
    return uniform(salt, *keys) * (hi - lo) + lo


def coin(p: float, salt: str, *keys) -> Column:
    return uniform(salt, *keys) < p


def gumbel(u: Column) -> Column:
    """Gumbel noise of a uniform, floored away from 0 and kept below 1."""
    return -F.log(-F.log(F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-20), u))))


def van_der_corput(index: Column, bits: int = 16) -> Column:
    """Base-2 radical inverse of a row number: the first dimension of an unscrambled Sobol sequence."""
    return F.conv(F.reverse(F.lpad(F.conv((index % (1 << bits)).cast("string"), 10, 2), bits, "0")), 2, 10).cast("double") / float(1 << bits)
