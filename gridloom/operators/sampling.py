"""Sampling from distributions in long form (id, k, logit), one row a vocabulary entry, and iterative generation on grids.

Windows run over one distribution, whose size is the vocabulary. Ties are ordered by k. Rows with a null logit are treated
as impossible entries: they get no probability and are never chosen.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.functions.rng import gumbel, uniform
from gridloom.functions.scalar import gamma
from gridloom.operators.ordered import rank_along, written

def _row():
    return W.partitionBy("id")


def softmax(df: DataFrame, temperature: float = 1.0, name: str = "p") -> DataFrame:
    """Adds the probability of each entry; a temperature of 0 or less counts as 1."""
    x = F.col("logit") / temperature if temperature > 0 else F.col("logit")
    e = F.exp(x - F.max(x).over(_row()))
    return df.withColumn("__e", F.coalesce(e, F.lit(0.0))).withColumn(name, F.col("__e") / F.sum("__e").over(_row())).drop("__e")


def _drop_from(df: DataFrame, keep: Column) -> DataFrame:
    return df.withColumn("logit", F.when(keep, F.col("logit")))


def top_k_keep(k: int) -> Column:
    """Whether an entry is at least the k-th largest; ties of it are kept."""
    return F.rank().over(_row().orderBy(F.desc_nulls_last("logit"))) <= k


def top_p_keep(p: float, prob: str = "p") -> Column:
    """Whether the probability before an entry, in descending order, is within p; the first entry past it is kept."""
    along = _row().orderBy(F.desc(prob), "k").rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(prob).over(along), F.lit(0.0)) <= p


def typical(df: DataFrame, mass: float = 0.95, min_tokens: int = 1) -> DataFrame:
    """Adds keep: entries whose surprise is near the entropy, up to the mass; with min_tokens over 1 the first of them always."""
    rows = softmax(df)
    logp = F.when(F.col("p") > 0, F.log("p"))
    rows = rows.withColumn("__s", F.abs(-logp - F.sum(F.coalesce(-F.col("p") * logp, F.lit(0.0))).over(_row())))
    order = _row().orderBy(F.asc_nulls_last("__s"), "k")
    rows = rows.withColumn("__rank", F.row_number().over(order)).withColumn("__cum", F.sum("p").over(order.rowsBetween(W.unboundedPreceding, 0)))
    last = F.least(F.count(F.when(F.col("__cum") < mass, 1)).over(_row()), F.count(F.lit(1)).over(_row()) - 1)
    rows = rows.withColumn("__last", last)
    cut = F.max(F.when(F.col("__rank") == F.col("__last") + 1, F.col("__s"))).over(_row())
    keep = F.coalesce(F.col("__s") <= cut, F.lit(False))
    if min_tokens > 1:
        keep = keep | (F.col("__rank") <= min_tokens)
    return rows.withColumn("keep", keep).drop("__s", "__rank", "__cum", "__last", "p")


def gumbel_argmax(df: DataFrame, temperature: float = 1.0, salt: str = "gumbel") -> DataFrame:
    """(id, k): the entry of largest logit / temperature plus Gumbel noise."""
    score = F.col("logit") / max(temperature, 1e-10) + gumbel(uniform(salt, "id", "k"))
    return df.filter(F.col("logit").isNotNull()).groupBy("id").agg(F.max_by("k", F.struct(score, -F.col("k"))).alias("k"))


def argmax(df: DataFrame) -> DataFrame:
    """(id, k): the entry of largest logit, the smallest k of equal ones."""
    return df.filter(F.col("logit").isNotNull()).groupBy("id").agg(F.max_by("k", F.struct("logit", -F.col("k"))).alias("k"))


def inverse_cdf(df: DataFrame, salt: str = "draw", prob: str = "p") -> DataFrame:
    """(id, k): the first entry at which the running probability exceeds the row's uniform."""
    cum = F.sum(prob).over(_row().orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    rows = df.withColumn("__cum", cum).withColumn("__u", uniform(salt, "id"))
    past = F.min(F.when((F.col("__cum") > F.col("__u")) & (F.col(prob) > 0), F.col("k")))
    return rows.groupBy("id").agg(F.coalesce(past, F.max(F.when(F.col(prob) > 0, F.col("k")))).alias("k"))


def sample(
    df: DataFrame, draw: bool = True, temperature: float = 1.0, top_k: int | None = None, top_p: float | None = None,
    typical_mass: float | None = None, typical_min: int = 1, salt: str = "draw",
) -> DataFrame:
    """(id, k, p): one entry of each distribution and its probability among those kept.

    Filters in order: typical (only if a mass is given; the imitated generator computes it without effect), top-k, top-p,
    then the temperature; a draw, or the largest logit.
    """
    rows = df
    if typical_mass is not None:
        rows = _drop_from(typical(rows, typical_mass, typical_min), F.col("keep")).drop("keep")
    if top_k is not None:
        rows = _drop_from(rows, top_k_keep(top_k))
    if top_p is not None and top_p < 1:
        rows = _drop_from(softmax(rows), top_p_keep(top_p)).drop("p")
    rows = softmax(rows, temperature)
    chosen = inverse_cdf(rows, salt) if draw else argmax(rows)
    return chosen.join(rows.select("id", "k", "p"), ["id", "k"])


#: Confidence of what is known: above any that noise can reach. Width of the buckets that spread ranks use.
_KNOWN, _WIDTH = 1e6, 0.02


def remask(df: DataFrame, n: Column | int, temperature: Column | float, key: str = "id", item: str = "pos", prob: str = "p", salt: str = "remask", spread: bool = False) -> DataFrame:
    """Adds m = 1 for entries less confident than the n-th (from 0) of their key, by ln p plus Gumbel noise.

    A null p means known: never masked. Equal confidences at the bound are not masked, so then fewer than n are. With spread,
    for keys that may be hot, ranks come from buckets of confidence instead of one window over the key.
    """
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    conf = F.when(F.col(prob).isNotNull(), F.log(F.greatest(F.col(prob), F.lit(1e-300))) + t * gumbel(uniform(salt, key, item)))
    rows = df.withColumn("__c", F.coalesce(conf, F.lit(_KNOWN))).withColumn("__n", n if isinstance(n, Column) else F.lit(n))
    at_cut = F.max(F.when(F.col("__r") == F.col("__n") + 1, F.col("__c")))
    if spread:
        rows = rank_along(rows, [key], ["__c", item], _WIDTH, "__r")
        rows = rows.join(rows.groupBy(key).agg(at_cut.alias("__cut")), key)
    else:
        rows = rows.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy("__c", item))).withColumn("__cut", at_cut.over(W.partitionBy(key)))
    all_below = F.when(F.col("__n") > 0, 1).otherwise(0)
    m = F.when(F.col("__c") == _KNOWN, 0).when(F.col("__cut").isNull(), all_below).when(F.col("__c") < F.col("__cut"), 1).otherwise(0)
    return rows.withColumn("m", m).drop("__c", "__n", "__r", "__cut")


def schedule(steps: int) -> list[float]:
    """Share still masked after each step."""
    return [min(1.0, max(1e-10, math.cos((i + 1) / steps * math.pi / 2))) for i in range(steps)]


#: Takes cells (keys, pos, step, unknown, ...) and adds `codes` and `logits`, the candidates of each unknown cell. It keeps all rows and columns.
Scorer = Callable[[DataFrame], DataFrame]


def hash_scorer(vocab: int, keys: tuple[str, ...] = ("clip_id",), salt: str = "score") -> Scorer:
    """A stand-in for a model: six candidates of each cell, their codes and logits cut from one hash of the cell and the step. Models plug in here."""

    def score(cells: DataFrame) -> DataFrame:
        h = F.md5(F.concat_ws("|", F.lit(salt), *[F.col(c).cast("string") for c in (*keys, "pos", "step")]))
        number = lambda at, n: F.conv(F.substring(F.col("__h"), at, n), 16, 10).cast("bigint")
        rows = cells.withColumn("__h", F.when(F.col("unknown"), h)).withColumn("__k", number(1, 8))
        codes = F.array(*[((F.col("__k") + 163 * j) % vocab).cast("int") for j in range(6)])
        logits_ = F.array(*[number(9 + 4 * j, 4) * 6 / F.lit(65536.0) for j in range(6)])
        return rows.withColumn("codes", F.when(F.col("unknown"), codes)).withColumn("logits", F.when(F.col("unknown"), logits_)).drop("__h", "__k")

    return score


def _cumulated(a: Column) -> Column:
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("c"))
    return F.aggregate(a, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["c"], F.array(acc["s"] + x)).alias("c")), lambda acc: acc["c"])


def choose(rows: DataFrame, u: Column | None, temperature: float = 1.0, top_k: int | None = None, top_p: float | None = None) -> DataFrame:
    """Adds k and p: one of the candidates `codes` by their `logits`, and its probability among those kept; u is a uniform, None takes the largest.

    Top-k, then top-p (what stands before a candidate is within it), then the temperature. Equal logits stand in the order
    of the array. Arrays are short, so all of it is one projection, without a row for each candidate and without an exchange.
    """
    order = F.array_sort(F.transform("logits", lambda x, j: F.struct((-x).alias("o"), j.alias("j"), F.get(F.col("codes"), j).alias("code"))))
    rows = rows.withColumn("__a", F.slice(order, 1, top_k) if top_k else order)
    heat = lambda t: F.transform("__a", lambda x: F.exp((F.get(F.col("__a"), F.lit(0))["o"] - x["o"]) / t))
    if top_p is not None and top_p < 1:
        rows = rows.withColumn("__c", _cumulated(heat(1.0)))
        bound = F.element_at("__c", -1) * top_p
        rows = rows.withColumn("__a", F.slice("__a", 1, 1 + F.size(F.filter(F.slice("__c", 1, F.greatest(F.size("__c") - 1, F.lit(0))), lambda c: c <= bound))))
    rows = rows.withColumn("__c", _cumulated(heat(temperature if temperature > 0 else 1.0)))
    total = F.element_at("__c", -1)
    at = F.lit(0) if u is None else F.least(F.size(F.filter("__c", lambda c: c <= u * total)), F.size("__c") - 1)
    rows = rows.withColumn("__i", at)
    p = (F.get("__c", F.col("__i")) - F.coalesce(F.get("__c", F.col("__i") - 1), F.lit(0.0))) / total
    return rows.withColumn("k", F.get("__a", F.col("__i"))["code"]).withColumn("p", p).drop("__a", "__c", "__i")


def generate(
    grid: DataFrame, scorer: Scorer, steps: int, token: int, conditioning: int = 0, temperature: float = 10.5, sampling_temperature: float = 1.0, top_k: int | None = None, top_p: float | None = None,
    sample_cutoff: float = 1.0, keys: tuple[str, ...] = ("clip_id",), checkpoint: bool = True,
) -> DataFrame:
    """The grid with its mask tokens filled in by so many rounds of scoring, sampling and re-masking of the least confident.

    grid: (keys, codebook, t, code, codebooks). The first `conditioning` codebooks stay. Counts are per group of keys. A round
    draws while its share of all rounds is within sample_cutoff, then takes the largest. Confidence is ln p plus Gumbel noise
    of a falling temperature; the bound below which cells are masked again comes from counts of narrow ranges of confidence, then
    from the one range that holds it, so no group is one task. Lineage is cut once a round by a table in the shared folder.
    """
    width, group = F.col("codebooks") - conditioning, list(keys)
    free = grid.filter(F.col("codebook") >= conditioning).select(*group, "codebook", "t", (F.col("t") * width + F.col("codebook") - conditioning).alias("pos"), F.coalesce("code", F.lit(token)).alias("code"))
    start = free.groupBy(*group).agg(F.count(F.when(F.col("code") == token, 1)).alias("n0"))
    state = free.join(start, group)
    for i in range(steps):
        r, last = (i + 1) / steps, i == steps - 1
        scored = scorer(state.withColumn("unknown", F.col("code") == token).withColumn("step", F.lit(i)))
        drawn = uniform(f"draw{i}", *group, "pos") if i / steps <= sample_cutoff else None
        rows = choose(scored, drawn, sampling_temperature, top_k, top_p).drop("codes", "logits", "step")
        rows = rows.withColumn("value", F.when(F.col("unknown"), F.col("k")).otherwise(F.col("code")).cast("int"))
        if last:
            state = rows.withColumn("code", F.col("value"))
            break
        noise = gumbel(uniform(f"remask{i}", *group, "pos")) * (temperature * (1 - r))
        rows = rows.withColumn("c", F.when(F.col("unknown"), F.log(F.greatest(F.col("p"), F.lit(1e-300))) + noise)).drop("k", "p").withColumn("range", F.floor(F.col("c") / _WIDTH))
        rows = written(rows) if checkpoint else rows
        sizes = rows.filter("unknown").groupBy(*group, "range").agg(F.count(F.lit(1)).alias("here"), F.max("n0").alias("n0"))
        along = W.partitionBy(*group).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
        sizes = sizes.withColumn("before", F.coalesce(F.sum("here").over(along), F.lit(0))).withColumn("left", F.sum("here").over(W.partitionBy(*group)))
        n = F.greatest(F.lit(1), F.least(F.col("left") - 1, F.floor(gamma(F.lit(r)) * F.col("n0"))))
        edge = sizes.withColumn("n", n).filter("before <= n and n < before + here").select(*group, "range", (F.col("n") - F.col("before") + 1).alias("place"))
        inside = rows.filter("unknown").select(*group, "range", "c", "pos").join(edge, [*group, "range"])
        cut = inside.withColumn("r", F.row_number().over(W.partitionBy(*group).orderBy("c", "pos"))).filter("r = place").select(*group, F.col("c").alias("cut"))
        again = F.col("unknown") & (F.col("cut").isNull() | (F.col("c") < F.col("cut")))
        state = rows.join(cut, group, "left").select(*group, "codebook", "t", "pos", F.when(again, token).otherwise(F.col("value")).alias("code"), "n0")
    kept = grid.filter(F.col("codebook") < conditioning).select(*group, "codebook", "t", "code")
    return kept.unionByName(state.select(*group, "codebook", "t", "code"))


def coarse_vamp(grid: DataFrame, mask: Column, gen_fn: Callable[[DataFrame], DataFrame], codebooks: int, token: int) -> tuple[DataFrame, DataFrame]:
    """(the grid with its first codebooks generated anew under the mask, those codebooks as they were masked).

    gen_fn takes and gives (clip_id, codebook, t, code, ...); the other codebooks are put back as they are.
    """
    masked = grid.filter(F.col("codebook") < codebooks).withColumn("code", F.when(mask == 1, token).otherwise(F.col("code"))).withColumn("codebooks", F.least("codebooks", F.lit(codebooks)))
    made = gen_fn(masked).select("clip_id", "codebook", "t", "code")
    return made.unionByName(grid.filter(F.col("codebook") >= codebooks).select("clip_id", "codebook", "t", "code")), masked.select("clip_id", "codebook", "t", "code")


def coarse_to_fine(grid: DataFrame, scorer: Scorer, steps: int, length: int, codebooks: int, conditioning: int, token: int, **kwargs) -> DataFrame:
    """(clip_id, codebook, t, code): the finer codebooks generated chunk by chunk, laid end to end and cut to the clip's steps.

    A chunk is a group of its own, so chunks of an endless clip are generated side by side.
    """
    chunks = fine_chunks(grid, length, codebooks, conditioning, token).withColumnRenamed("step", "t").withColumn("codebooks", F.lit(codebooks))
    made = generate(chunks.drop("m"), scorer, steps, token, conditioning, keys=("clip_id", "chunk"), **kwargs)
    extent = grid.select("clip_id", "steps").distinct()
    whole = made.select("clip_id", "codebook", (F.col("chunk") * length + F.col("t")).cast("int").alias("t"), "code")
    return whole.join(extent, "clip_id").filter("t < steps").select("clip_id", "codebook", "t", "code")


def one_step(grid: DataFrame, scorer: Scorer, token: int) -> DataFrame:
    """(clip_id, codebook, t, code): every mask token replaced by its likeliest candidate at once."""
    rows = grid.select("clip_id", "codebook", "t", (F.col("t") * F.col("codebooks") + F.col("codebook")).alias("pos"), F.coalesce("code", F.lit(token)).alias("code"))
    rows = choose(scorer(rows.withColumn("unknown", F.col("code") == token).withColumn("step", F.lit(0))), None)
    return rows.select("clip_id", "codebook", "t", F.when(F.col("unknown"), F.col("k")).otherwise(F.col("code")).cast("int").alias("code"))


def fine_chunks(grid: DataFrame, length: int, codebooks: int, conditioning: int, token: int) -> DataFrame:
    """(clip_id, chunk, codebook, step, code, m): chunks of so many steps for the fine model, each a group of its own.

    The last chunk is padded with code 0 that is kept; codebooks beyond those given are added, masked; the conditioning
    codebooks are kept.
    """
    coarse = grid.select("clip_id", "steps").distinct()
    whole = (F.ceil(F.col("steps") / length) * length).cast("int")
    cells = coarse.withColumn("t", F.explode(F.sequence(F.lit(0), whole - 1))).withColumn("codebook", F.explode(F.sequence(F.lit(0), F.lit(codebooks - 1))))
    rows = cells.join(grid.select("clip_id", "codebook", "t", "code"), ["clip_id", "codebook", "t"], "left")
    padded = F.col("t") >= F.col("steps")
    m = F.when((F.col("codebook") < conditioning) | padded, 0).otherwise(1)
    code = F.when(padded, 0).when(m == 1, token).otherwise(F.coalesce("code", F.lit(0)))
    return rows.select("clip_id", F.floor(F.col("t") / length).cast("int").alias("chunk"), "codebook", (F.col("t") % length).cast("int").alias("step"), code.cast("int").alias("code"), m.cast("int").alias("m"))
