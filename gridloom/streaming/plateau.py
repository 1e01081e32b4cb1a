"""Learning-rate schedules as folds over ordered metrics: one pure step, run over sorted batches or as a stream's state.

A batch fold sorts each partition by run and step and passes over its rows once, holding one state; nothing is collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE_SCHEMA = "best double, previous double, epoch long, bad long, lr double, exceeded long"
OUT_SCHEMA = "run string, step long, best double, bad long, lr double"


@dataclass(frozen=True)
class Plateau:
    """Settings of the schedule. A factor above 1 raises the rate when progress stops."""

    factor: float = 0.5
    patience: int = 10
    min_lr: float = 1e-6
    threshold: float = 0.001
    relative: bool = True
    maximise: bool = False

    def better(self, a: float, best: float) -> bool:
        if self.maximise:
            return a > best * (1 + self.threshold) if self.relative else a > best + self.threshold
        return a < best * (1 - self.threshold) if self.relative else a < best - self.threshold


@dataclass(frozen=True)
class State:
    best: float = 10.0
    previous: float | None = None
    epoch: int = 0
    bad: int = 0
    lr: float = 1e-3
    exceeded: int = 0


def step(cfg: Plateau, s: State, loss: float, grad: float | None) -> State:
    """The state after one metric; a null or NaN gradient norm is no gradient norm, a NaN loss is no progress.

    A best of 0 starts again at 10. A norm above 1, or twice the previous one, lowers the rate at once and ends the step.
    """
    grad = None if grad is None or (isinstance(grad, float) and math.isnan(grad)) else grad
    best = 10.0 if s.best == 0 else s.best
    bad = s.bad + 1
    if cfg.better(loss, best):
        best, bad = loss, 0
    s = replace(s, best=best, bad=bad, epoch=s.epoch + 1)
    if grad is not None:
        if s.previous is not None and (grad > 1.0 or grad > 2 * s.previous):
            down = 1 / cfg.factor if cfg.factor > 1 else cfg.factor
            return replace(s, lr=max(s.lr * down, cfg.min_lr), bad=0, previous=grad)
        s = replace(s, previous=grad)
    if s.bad > cfg.patience:
        s = replace(s, lr=max(s.lr * cfg.factor, cfg.min_lr), bad=0)
    return s


def exceed(cfg: Plateau, s: State, grad: float, clip: float, after: int = 10) -> State:
    """Counts clipped gradients; the `after`-th lowers the rate by 2 - factor and starts the count again."""
    if not cfg.factor > 1 or not grad > clip:
        return s
    n = s.exceeded + 1
    return replace(s, exceeded=0, lr=max(s.lr * (2 - cfg.factor), cfg.min_lr)) if n >= after else replace(s, exceeded=n)


def fold(df: DataFrame, cfg: Plateau = Plateau(), start: State = State()) -> DataFrame:
    """(run, step, best, bad, lr) after each row (run, step, loss, grad), in the order of step within a run."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, s = None, start
        for pdf in batches:
            out = []
            for r, at, loss, grad in zip(pdf["run"], pdf["step"], pdf["loss"], pdf["grad"]):
                if r != run:
                    run, s = r, start
                s = step(cfg, s, loss, None if pd.isna(grad) else grad)
                out.append((r, at, s.best, s.bad, s.lr))
            yield pd.DataFrame(out, columns=["run", "step", "best", "bad", "lr"])

    rows = df.filter("run is not null and step is not null and loss is not null").select("run", "step", "loss", "grad")
    return rows.repartition("run").sortWithinPartitions("run", "step").mapInPandas(walk, OUT_SCHEMA)


def stream(df: DataFrame, cfg: Plateau = Plateau(), start: State = State()) -> DataFrame:
    """The fold over a stream: rows of a micro-batch are taken in the order of step, the state is carried on."""

    def update(key, batches, state):
        s = State(*state.get) if state.exists else start
        pdf = pd.concat(list(batches)).sort_values("step", kind="stable")
        out = []
        for at, loss, grad in zip(pdf["step"], pdf["loss"], pdf["grad"]):
            s = step(cfg, s, loss, None if pd.isna(grad) else grad)
            out.append((key[0], at, s.best, s.bad, s.lr))
        state.update(astuple(s))
        yield pd.DataFrame(out, columns=["run", "step", "best", "bad", "lr"])

    rows = df.filter("run is not null and step is not null and loss is not null").select("run", "step", "loss", "grad")
    return rows.groupBy("run").applyInPandasWithState(update, OUT_SCHEMA, STATE_SCHEMA, "append", "NoTimeout")


def available(stream_df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything that the source holds now, through the stream into a table at path; running it again goes on from the checkpoint."""
    stream_df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream_df.sparkSession.read.parquet(path)


def best_so_far(df: DataFrame, keys: list[str], order: str, value: str, width: float) -> DataFrame:
    """Adds best, the smallest value up to a row, and is_best, whether the row improved on all before; ordered by buckets."""
    from pyspark.sql import Window as W

    rows = df.withColumn("__b", F.floor(F.col(order) / width))
    low = rows.groupBy(*keys, "__b").agg(F.min(value).alias("__low"))
    before = low.select(*keys, "__b", F.min("__low").over(W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    inner = F.min(value).over(W.partitionBy(*keys, "__b").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("__in", inner).join(before, [*keys, "__b"]).withColumn("__past", F.least("__in", "__before"))
    return rows.withColumn("best", F.least(value, "__past")).withColumn("is_best", F.coalesce(F.col(value) < F.col("__past"), F.col(value).isNotNull())).drop("__b", "__in", "__before", "__past")
