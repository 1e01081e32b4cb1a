"""Named experiment conditions: transforms of a token grid, and the suites that list them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import masks as M
from gridloom.sources.grid import MASK

Condition = Callable[[DataFrame], DataFrame]


def _apply(mask: Callable) -> Condition:
    return lambda grid: grid.withColumn("m", mask().cast("int")).withColumn("code", M.apply(F.col("code"), F.col("m"), MASK))


def baseline(grid: DataFrame) -> DataFrame:
    return grid.withColumn("m", F.lit(0))


def reconstructed(grid: DataFrame) -> DataFrame:
    """Tokens as they are: what a codec gives back without a model between."""
    return baseline(grid)


def mask_ratio(ratio: float) -> Condition:
    return _apply(lambda: M.linear_random(F.lit(ratio)))


def inpaint(steps: int) -> Condition:
    """Keeps so many steps at either end."""
    return _apply(lambda: M.inpaint(steps, steps))


def periodic(period: int) -> Condition:
    return _apply(lambda: M.periodic(period, 1))


def coarse(conditioning: int, factor: int) -> Condition:
    """A time-stretched mask; the conditioning codebooks have no effect on it, as in what it imitates."""
    return _apply(lambda: M.time_stretch(factor))


def token_noise(amount: float) -> Condition:
    return lambda grid: grid.withColumn("m", M.linear_random(F.lit(amount)).cast("int")).withColumn("code", M.noise(F.col("code"), F.col("m"), MASK))


# The suites by name and the parameters of their conditions.
SUITES: dict[str, dict[str, Condition]] = {
    "gen-compression": {"baseline": baseline, "reconstructed": reconstructed, **{f"mask_ratio_{r}": mask_ratio(r) for r in (0.25, 0.5, 0.75)}, **{f"token_noise_{r}": token_noise(r) for r in (0.1, 0.25)}},
    "inpaint": {"baseline": baseline, **{f"inpaint_{s}": inpaint(int(s * 57)) for s in (0.5, 1.0, 2.0)}},
    "periodic": {"baseline": baseline, **{f"periodic_{p}": periodic(p) for p in (3, 7, 13)}, "coarse2fine": coarse(1, 4)},
}


def run(grid: DataFrame, suite: str, done: DataFrame | None = None) -> DataFrame:
    """(condition, cells...) of every condition of the suite over the clips that not all conditions are done for (clip_id, condition)."""
    conditions = SUITES[suite]
    if done is not None:
        ready = done.filter(F.col("condition").isin(*conditions)).groupBy("clip_id").agg(F.countDistinct("condition").alias("n")).filter(F.col("n") == len(conditions))
        grid = grid.join(ready.select("clip_id"), "clip_id", "left_anti")
    out = None
    for name, f in conditions.items():
        rows = f(grid).select(F.lit(name).alias("condition"), "clip_id", "codebook", "t", "code", "m")
        out = rows if out is None else out.unionByName(rows)
    return out
