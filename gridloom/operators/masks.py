"""Mask algebra over token grids: a mask is a 0/1 column, 1 = to be generated, 0 = kept as a hint.

Domain columns are codebook, t, steps (length of the clip) and clip_id. All functions are column expressions, so a chain of
them is one projection over the scan. Bernoulli draws use hashed uniforms of the cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.rng import uniform
from gridloom.functions.scalar import gamma, seconds_to_tokens, slice_start
from gridloom.operators.ordered import rank_along

CELL = ("clip_id", "codebook", "t")
#: Seconds of a bucket when beats of a clip are ranked.
BEAT_BUCKET = 60.0


def full() -> Column:
    return F.lit(1)


def empty() -> Column:
    return F.lit(0)


def random(r: Column, salt: str = "random") -> Column:
    """Each cell by itself with the probability that the cosine schedule gives to r."""
    return (uniform(salt, *CELL) < gamma(r)).cast("int")


def linear_random(r: Column, salt: str = "linear") -> Column:
    return (uniform(salt, *CELL) < r).cast("int")


def inpaint(prefix: int, suffix: int) -> Column:
    """Keeps the first and last steps; 0 switches a side off."""
    return F.when((F.col("t") < prefix) | (F.col("t") >= F.col("steps") - suffix), 0).otherwise(1)


def periodic(period: int, width: int = 1, offset: Column | int = 0) -> Column:
    """Keeps steps within width // 2 of each multiple of the period, rolled by offset; period 0 keeps nothing."""
    if period == 0:
        return F.lit(1)
    half = width // 2
    at = F.pmod(F.col("t") - offset, F.col("steps"))
    after = at % period
    upcoming = at + period - after
    return F.when((after <= half) | ((upcoming - at <= half) & (upcoming < F.col("steps"))), 0).otherwise(1)


def roll_offset(period: int, salt: str = "roll") -> Column:
    """One offset below the period for the whole batch."""
    return F.floor(uniform(salt) * period).cast("int")


def time_stretch(factor: int) -> Column:
    return periodic(factor, 1)


def codebook_unmask(m: Column, n: int | None) -> Column:
    """Keeps the first n codebooks; a negative n counts from the last one, none leaves the mask."""
    if n is None:
        return m
    bound = F.lit(n) if n >= 0 else F.col("codebooks") + n
    return F.when(F.col("codebook") < bound, 0).otherwise(m)


def codebook_mask(m: Column, start: int) -> Column:
    return F.when(F.col("codebook") >= start, 1).otherwise(m)


def both(a: Column, b: Column) -> Column:
    return F.least(a, b)


def either(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def dropout(m: Column, p: float, salt: str = "dropout") -> Column:
    """Drops hints: a kept cell becomes masked with probability p."""
    return F.when((m == 0) & (uniform(salt, *CELL) < p), 1).otherwise(m)


def apply(code: Column, m: Column, token: int) -> Column:
    return F.when(m == 1, token).otherwise(code)


def noise(code: Column, m: Column, vocab: int, salt: str = "noise") -> Column:
    """A uniform random code where the mask is 1."""
    return F.when(m == 1, F.floor(uniform(salt, *CELL) * vocab).cast("int")).otherwise(code)


def target(code: Column, m: Column) -> Column:
    """Codes to be predicted: those of masked cells, null elsewhere."""
    return F.when(m == 1, code)


def _stamped(points: DataFrame, start: Column, stop: Column) -> DataFrame:
    lo, hi = slice_start(start, F.col("steps")), slice_start(stop, F.col("steps"))
    return points.withColumn("t", F.explode(F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))))


def onset_mask(grid: DataFrame, onsets: DataFrame, width: int, rate: int, hop: int, name: str = "m", extent: DataFrame | None = None) -> DataFrame:
    """The grid with a column m (or `name`), 0 on width steps on either side of each onset (clip_id, beat_s), 1 elsewhere.

    An onset index is clipped to the clip; a start below 0 counts from the end, so early onsets often keep nothing; a clip
    without any onset is all 0. extent (clip_id, steps) saves deriving it from the grid. Stamps are exploded and joined by equality, not by a range.
    """
    extent = grid.select("clip_id", "steps").distinct() if extent is None else extent
    index = F.greatest(F.lit(0), F.least(F.floor(F.col("beat_s") * rate / hop).cast("int"), F.col("steps") - 1))
    points = onsets.join(extent, "clip_id").select("clip_id", "steps", index.alias("o")).distinct()
    stamps = _stamped(points, F.col("o") - width, F.col("o") + width).select("clip_id", "t").distinct().withColumn("hint", F.lit(True))
    some = points.select("clip_id").distinct().withColumn("some", F.lit(True))
    rows = grid.join(stamps, ["clip_id", "t"], "left").join(some, "clip_id", "left")
    return rows.withColumn(name, F.when(F.col("some").isNull() | F.col("hint").isNotNull(), 0).otherwise(1)).drop("hint", "some")


def beat_mask(
    grid: DataFrame, beats: DataFrame, rate: int, hop: int, before_s: float = 0.0, after_s: float = 0.02, downbeats: bool = True, upbeats: bool = True,
    downbeat_stride: int = 1, beat_stride: int = 1, p_dropout: float = 0.0, invert: bool = True, name: str = "m", extent: DataFrame | None = None,
) -> DataFrame:
    """The grid with a column m (or `name`) from stamps of a Bernoulli(1 - dropout) bit on [beat - before, beat + after); later stamps overwrite, downbeats after other beats.

    Beats at the token of a downbeat count as downbeats; of either kind every stride-th is used. A start below 0 counts
    from the end. Inverted (the default) stamped cells are hints.
    """
    if min(downbeat_stride, beat_stride) < 1:
        raise ValueError("strides are 1 or more")
    to_t = lambda s: seconds_to_tokens(s, rate, hop)
    extent = grid.select("clip_id", "steps").distinct() if extent is None else extent
    points = beats.join(extent, "clip_id").withColumn("o", to_t(F.col("beat_s")))
    down = points.filter("is_downbeat").select("clip_id", "o").distinct()
    up = points.join(down, ["clip_id", "o"], "left_anti") if upbeats else points.filter("false")
    down = points.filter("is_downbeat") if downbeats else points.filter("false")
    kinds = []
    for kind, rows, stride in ((0, up, beat_stride), (1, down, downbeat_stride)):
        ranked = rank_along(rows.select("clip_id", "steps", "beat_s", "o"), ["clip_id"], ["beat_s"], BEAT_BUCKET)
        kinds.append(ranked.filter((F.col("rank") - 1) % stride == 0).withColumn("kind", F.lit(kind)))
    stamps = _stamped(kinds[0].unionByName(kinds[1]), F.col("o") - to_t(F.lit(before_s)), F.col("o") + to_t(F.lit(after_s)))
    bit = (uniform("beat", "clip_id", "kind", "rank", "t") < 1 - p_dropout).cast("int")
    bits = stamps.groupBy("clip_id", "t").agg(F.max_by(bit, F.struct("kind", "rank")).alias("bit"))
    m = F.coalesce("bit", F.lit(0))
    return grid.join(bits, ["clip_id", "t"], "left").withColumn(name, 1 - m if invert else m).drop("bit")


def compose(r: float, prefix: int, suffix: int, period: int, width: int, p_dropout: float, keep: int, mask_from: int, onset: Column | None = None, beat: Column | None = None) -> Column:
    """The interactive composition: random and inpaint and rolled period, or onsets, and beats, then dropout and codebooks, in this order.

    onset and beat are mask columns of the same rows, as onset_mask and beat_mask add them.
    """
    m = both(both(linear_random(F.lit(r)), inpaint(prefix, suffix)), periodic(period, width, roll_offset(period)))
    if onset is not None:
        m = either(m, onset)
    if beat is not None:
        m = both(m, beat)
    return codebook_mask(codebook_unmask(dropout(m, p_dropout), keep), mask_from)


def silent_steps(grid: DataFrame, token: int) -> DataFrame:
    """(clip_id, t, silent): whether any codebook holds the mask token at that step."""
    return grid.groupBy("clip_id", "t").agg(F.coalesce(F.bool_or(F.col("code") == token), F.lit(False)).alias("silent"))


def flat_position(codebooks: Column) -> Column:
    """Time-major place with the codebook running fastest."""
    return F.col("t") * codebooks + F.col("codebook")


def unflatten(pos: Column, codebooks: Column) -> tuple[Column, Column]:
    """(t, codebook) of a flat place."""
    return F.floor(pos / codebooks).cast("int"), (pos % codebooks).cast("int")
