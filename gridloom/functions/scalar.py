"""Closed-form scalar functions on columns: schedules, token time, rounding, activations, levels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma(r: Column) -> Column:
    """Cosine masking schedule: the share still masked at progress r."""
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-10), F.cos(r * math.pi / 2)))


def inverse_gamma(y: Column) -> Column:
    return F.acos(y) * 2 / math.pi


def seconds_to_tokens(s: Column, rate: int, hop: int) -> Column:
    return F.ceil(s * rate / hop).cast("int")


def tokens_to_seconds(t: Column, rate: int, hop: int) -> Column:
    return t * hop / F.lit(float(rate))


def snap_seconds(s: Column, rate: int, hop: int) -> Column:
    """Seconds moved up to the token grid."""
    return tokens_to_seconds(seconds_to_tokens(s, rate, hop), rate, hop)


def feature_frame(s: Column, rate: int, samples: Column | int, frames: Column | int) -> Column:
    """Frame of a feature matrix of so many frames over so many samples, truncated."""
    return (s * rate / samples * frames).cast("bigint")


def noam_rate(step: Column, d_model: int, warmup: int, factor: float) -> Column:
    return F.lit(factor * d_model**-0.5) * F.least(F.pow(step, F.lit(-0.5)), step * warmup**-1.5)


def round_to_multiple(x: Column, multiple: int) -> Column:
    """Nearest multiple, halves to the even one."""
    return (F.bround(x / multiple, 0) * multiple).cast("bigint")


def decibels(x: Column) -> Column:
    return F.log10(x) * 20


def bitrate(rate: int, hop: int, codebooks: Column, downsample: int = 1) -> Column:
    return F.lit(rate / hop) * (codebooks * 10 / downsample)


def gelu_tanh(x: Column) -> Column:
    return x * 0.5 * (F.tanh((x + F.pow(x, F.lit(3.0)) * 0.044715) * math.sqrt(2 / math.pi)) + 1)


def snake(x: Column, alpha: float) -> Column:
    return x + F.pow(F.sin(x * alpha), F.lit(2.0)) / (alpha + 1e-9)


def film(x: Column, scale: Column, shift: Column) -> Column:
    return x * scale + shift


ACTIVATIONS = {"relu": lambda x: F.greatest(x, F.lit(0.0)), "gelu": gelu_tanh, "snake": lambda x: snake(x, 1.0)}


def activation(name: str = "relu"):
    """The activation of that name; unknown names are refused."""
    if name not in ACTIVATIONS:
        raise ValueError(f"unknown activation {name}")
    return ACTIVATIONS[name]


def relative_bucket(distance: Column, buckets: int = 32, max_distance: int = 128) -> Column:
    """Bidirectional relative-position bucket: half the buckets a sign, exact near zero, logarithmic beyond."""
    half = buckets // 2
    exact = half // 2
    n = F.abs(distance)
    far = F.lit(exact) + F.floor(F.log(F.greatest(n, F.lit(1)) / float(exact)) / math.log(max_distance / exact) * (half - exact))
    return (F.when(distance > 0, half).otherwise(0) + F.when(n < exact, n).otherwise(F.least(far, F.lit(half - 1)))).cast("int")


def sinusoid(r: Column, channel: int, channels: int, max_positions: int = 10000) -> Column:
    """One channel of the sinusoidal embedding of a schedule position."""
    half = channels // 2
    x = r * max_positions * math.exp(-math.log(max_positions) / (half - 1) * (channel % half))
    return F.sin(x) if channel < half else F.cos(x)


def slice_start(s: Column, size: Column) -> Column:
    """Where a slice that starts at s begins in a sequence: a negative start counts from the end."""
    return F.when(s < 0, F.greatest(size + s, F.lit(0))).otherwise(F.least(s, size))
