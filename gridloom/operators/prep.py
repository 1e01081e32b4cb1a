"""Dataset preparation: levels, chunk rules, silence, splits, mix-down, resampling of files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import text
from gridloom.functions.rng import uniform
from gridloom.operators.ordered import rank_along

# Levels and lengths of the preparation rules (dB, ms).
MIN_LOUDNESS, MIN_DBFS, MAX_PEAK = -30.0, -40.0, 0.987
CHUNK, LONG, STEP, SLACK = 10_000, 70_000, 60_000, 1_000


def loud_enough(loudness: str = "loudness", least: float = MIN_LOUDNESS) -> Column:
    """Quiet clips are those below the bound; NaN, null and minus infinity are not loud enough."""
    return F.coalesce((F.col(loudness) >= least) & ~F.isnan(loudness), F.lit(False))


def not_silent(dbfs: str = "dbfs") -> Column:
    return F.coalesce((F.col(dbfs) > MIN_DBFS) & ~F.isnan(dbfs), F.lit(False))


def below_peak(peak: str = "peak") -> Column:
    return F.coalesce(F.col(peak) < MAX_PEAK, F.lit(False))


def chunk_starts(duration: Column, lead: Column | None = None) -> Column:
    """Starts in ms of the ten-second chunks that the rules cut from a clip; lead is its leading silence.

    Below ten seconds the clip is tiled to one chunk; up to seventy, one chunk after the leading silence if it fits; from
    there on, one at each minute that it fits. Unknown, zero and negative durations give none.
    """
    lead = F.lit(0) if lead is None else lead
    whole = (duration / STEP).cast("int")
    minutes = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(whole, F.lit(1))), lambda i: (i * STEP).cast("bigint")), lambda s: s + CHUNK <= duration)
    none = F.array().cast("array<bigint>")
    one = F.array(lead.cast("bigint"))
    middle = F.when(lead + CHUNK <= duration, one).otherwise(none)
    return F.when(duration.isNull() | (duration <= 0), none).when(duration < CHUNK, F.array(F.lit(0).cast("bigint"))).when(duration == CHUNK, F.when(duration - lead > SLACK, one).otherwise(none)).when(duration < LONG, middle).otherwise(minutes)


def tiles_needed(duration: Column) -> Column:
    """How often a short clip is repeated before it is cut to the chunk length."""
    return F.when((duration > 0) & (duration < CHUNK), F.floor(F.lit(CHUNK) / duration).cast("int") + 1).otherwise(1)


def chunks(clips: DataFrame, duration: str = "duration_ms") -> DataFrame:
    """(clip_id, i, start_ms, name): one row a chunk of the clips that are not silent."""
    rows = clips.filter(not_silent()).select("clip_id", "path", F.col(duration).alias("d"), F.posexplode(chunk_starts(F.col(duration))).alias("pos", "start_ms"))
    i = F.when(F.col("d") >= LONG, (F.col("start_ms") / STEP).cast("int")).otherwise(F.col("pos") + 1)
    return rows.select("clip_id", i.cast("int").alias("i"), "start_ms", F.concat(text.stem(F.col("path")), F.lit("_"), text.zero_pad(i.cast("int"))).alias("name"))


def silence_edges(levels: DataFrame, key: str, at: str, level: str, threshold: float, step_ms: int = 10) -> DataFrame:
    """(key, lead_ms, trail_ms): silent steps before the first and after the last loud one; a key without any is silent throughout.

    The trailing run counts one step at least, as the imitated rule does.
    """
    loud = F.col(level) >= threshold
    rows = levels.groupBy(key).agg(F.min(at).alias("a"), F.max(at).alias("b"), F.min(F.when(loud, F.col(at))).alias("x"), F.max(F.when(loud, F.col(at))).alias("y"))
    n = F.col("b") - F.col("a") + 1
    lead = F.coalesce(F.col("x") - F.col("a"), n)
    trail = F.greatest(F.lit(1), F.coalesce(F.col("b") - F.col("y"), n))
    return rows.select(key, (lead * step_ms).cast("bigint").alias("lead_ms"), (trail * step_ms).cast("bigint").alias("trail_ms"))


def split_by_hash(df: DataFrame, key: str, test_share: float, seed: int) -> DataFrame:
    """Adds split: the first ceil(share * n) rows in the order of a seeded hash of the key are test, the others train.

    The order is ranked by hash ranges, so no single task sorts the table; keys are assumed to be unique.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint")
    ranked = rank_along(df.withColumn("__one", F.lit(1)).withColumn("__h", h), ["__one"], ["__h", key], float(1 << 22), "__rank")
    total = df.agg(F.ceil(F.count(F.lit(1)) * test_share).alias("__tests"))
    return ranked.crossJoin(F.broadcast(total)).withColumn("split", F.when(F.col("__rank") <= F.col("__tests"), "test").otherwise("train")).drop("__one", "__h", "__rank", "__tests")  # one row


def peak_normalise(x: Column, to: float = 0.988) -> Column:
    """An array scaled so that its largest magnitude is `to`; silence stays."""
    peak = F.array_max(F.transform(x, lambda v: F.abs(v)))
    return F.when(peak > 0, F.transform(x, lambda v: v / peak * to)).otherwise(x)


def peak_cap(x: Column) -> Column:
    """An array scaled down where it exceeds 1."""
    peak = F.array_max(F.transform(x, lambda v: F.abs(v)))
    return F.when(peak > 1, F.transform(x, lambda v: v / peak)).otherwise(x)


def mixdown(tracks: DataFrame, name: str, samples: str) -> DataFrame:
    """(base, i, value): tracks of a base name (what stands before the last dash) added sample by sample, as long as the first by name."""
    rows = tracks.select(text.before_last_dash(F.col(name)).alias("base"), F.col(name).alias("name"), F.size(samples).alias("n"), F.posexplode(samples).alias("i", "v"))
    first = tracks.groupBy(text.before_last_dash(F.col(name)).alias("base")).agg(F.min_by(F.size(samples), F.col(name)).alias("limit"))
    return rows.groupBy("base", "i").agg(F.sum("v").alias("value")).join(first, "base").filter(F.col("i") < F.col("limit")).drop("limit")


def augmentations(chunks: DataFrame, n: int, ratios: list[float]) -> DataFrame:
    """Each chunk n times, with a ratio chosen by hash."""
    from gridloom.functions.rng import uniform

    rows = chunks.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pick = F.floor(uniform("ratio", "clip_id", "i", "variant") * len(ratios)).cast("int")
    return rows.withColumn("ratio", F.element_at(F.array(*map(F.lit, ratios)), pick + 1))


def tile_to(x: Column, length: int) -> Column:
    """An array repeated and cut to the length; an empty one stays empty."""
    times = F.when(F.size(x) > 0, F.floor(F.lit(length) / F.size(x)).cast("int") + 1).otherwise(0)
    return F.slice(F.flatten(F.array_repeat(x, times)), 1, length)


def weighted_loader(items: DataFrame, source: str, key: str, weights: dict, draws: int, offset: int = 0, salt: str = "load") -> DataFrame:
    """(draw, source, key): draws with replacement, a source by its weight and an item of it evenly.

    A draw depends on its number alone, so a loader that resumes at an offset gives what an endless one would have given.
    Sources without items give a null key.
    """
    from gridloom.operators.ordered import rank_along

    rows = rank_along(items.filter(F.col(source).isin(*weights)).select(source, key), [source], [key], 4096.0)
    sizes = items.filter(F.col(source).isin(*weights)).groupBy(source).agg(F.count(F.lit(1)).alias("__n"))
    bound, pick = 0.0, None
    at, total = uniform(salt + "-source", "draw"), float(sum(weights.values()))
    for name, weight in weights.items():
        bound += weight / total
        pick = F.when(at < bound, F.lit(name)) if pick is None else pick.when(at < bound, F.lit(name))
    drawn = items.sparkSession.range(offset, offset + draws).select(F.col("id").alias("draw")).withColumn(source, pick.otherwise(F.lit(list(weights)[-1])))
    placed = drawn.join(F.broadcast(sizes), source, "left").withColumn("rank", F.floor(uniform(salt, "draw") * F.col("__n")) + 1)  # one row a source
    return placed.join(rows, [source, "rank"], "left").select("draw", source, key)


def latest(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """(keys, value) of the last time, the largest value of equal ones."""
    return df.groupBy(*keys).agg(F.max(F.struct(time, value)).alias("r")).select(*keys, F.col(f"r.{value}").alias(value))
