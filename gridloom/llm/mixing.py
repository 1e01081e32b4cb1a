"""Mixing sources to target weights: systematic sampling over prefix sums of each document's expected copies.

The size of a text is its number of tokens: maximal runs of letters, maximal runs of digits, other non-blank characters; or
the tokens of a tokenizer file (`tokenizer`, a path). T is half of the size of all documents that have a text and a source.
A source of share w contributes w * T, but every document at most max_repeats times.

Within a source, documents stand in the order of a hash of their id; each adds its expected copies to a running sum that
starts at one random offset, and is emitted once for each integer that the sum crosses. Running sums come from counts of
hash ranges, so no source passes through one task. Sources are compared trimmed and in lower case. Documents without text
or source are not used; an empty text has size 0. Repeated rows of one doc_id count each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .vectors import shared_dir

#: Documents of a hash range, about.
RANGE_ROWS = 20_000
_TOKEN = r"(?U)\p{L}+|\p{Nd}+|[^\s\p{L}\p{Nd}]"


def size_of(column: str = "text") -> F.Column:
    return F.regexp_count(F.col(column), F.lit(_TOKEN)).cast("bigint")


def sized(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, size) of the documents that have a text and a source."""
    source = F.lower(F.trim(F.col("source")))
    rows = docs.filter(F.col("text").isNotNull() & F.col("source").isNotNull() & (source != ""))
    if tokenizer is None:
        return rows.select("doc_id", source.alias("source"), size_of().alias("size"))
    import pandas as pd

    @F.pandas_udf("bigint")
    def tokens(s: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        return pd.Series([len(e.ids) for e in t.encode_batch(s.tolist(), add_special_tokens=False)])

    return rows.select("doc_id", source.alias("source"), tokens("text").alias("size"))


def totals(rows: DataFrame) -> DataFrame:
    """(source, docs, size) of sized rows."""
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("size").alias("size"))


def rates(targets: DataFrame, per_source: DataFrame) -> DataFrame:
    """The targets with size, wanted tokens and expected copies of each document of the source."""
    t = per_source.agg(F.floor(F.coalesce(F.sum("size"), F.lit(0)) / 2).alias("t"))
    plan = targets.select("plan_id", "source", F.lower(F.trim("source")).alias("key"), "target_share", "max_repeats")
    rows = plan.join(per_source.select(F.col("source").alias("key"), "size"), "key", "left").crossJoin(F.broadcast(t))  # one row
    size = F.coalesce("size", F.lit(0))
    wanted = F.col("target_share") * F.col("t")
    rate = F.when(size > 0, F.least(wanted / size, F.col("max_repeats").cast("double"))).otherwise(0.0)
    return rows.select("plan_id", "source", "key", "target_share", "max_repeats", size.alias("size"), wanted.alias("wanted"), rate.alias("rate"), "t")


def unreachable(docs: DataFrame, targets: DataFrame, seed: int = 43, tokenizer: str | None = None) -> DataFrame:
    """(plan_id, source): targets that the mixture misses although it uses every text of the source as often as it may."""
    rows = shares(docs, targets, seed, tokenizer)
    return rows.filter((F.col("tokens") < F.col("wanted")) & (F.col("tokens") >= F.col("max_repeats") * F.col("size"))).select("plan_id", "source")


def mixture(docs: DataFrame, targets: DataFrame, seed: int = 43, tokenizer: str | None = None) -> DataFrame:
    """(plan_id, source, doc_id, size, copies): the documents of each plan's mixture, copies of 1 or more."""
    path = f"{shared_dir(docs.sparkSession).rstrip('/')}/mixture-{uuid.uuid4().hex}"
    sized(docs, tokenizer).withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)  # sizes are counted once
    return _drawn(rows, targets, seed)


def _drawn(rows: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    plan = rates(targets, totals(rows)).filter("rate > 0").select("plan_id", "key", "rate", F.col("source").alias("named"))
    ranges = max(16, rows.count() // RANGE_ROWS)
    keyed = rows.withColumn("range", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") * ranges / F.lit(1 << 32)))
    n = keyed.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n"))
    before = n.select("source", "range", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("source", "range").orderBy("h", "doc_id", "size"))
    placed = keyed.withColumn("place", place).join(before, ["source", "range"]).withColumn("k", F.col("before") + F.col("place") - 1)
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col("plan_id").cast("string"), F.lit(":"), F.col("key")))
    offset = F.conv(F.substring(draw, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    joined = placed.join(plan.withColumn("offset", offset), placed["source"] == plan["key"])
    # rounding keeps a sum that is an integer up to rounding errors on one side for both of its neighbours
    upto = lambda k: F.floor(F.round(k * F.col("rate") + F.col("offset"), 9))
    copies = upto(F.col("k") + 1) - upto(F.col("k"))
    return joined.withColumn("copies", copies).filter("copies > 0").select("plan_id", F.col("named").alias("source"), "doc_id", "size", "copies")


def shares(docs: DataFrame, targets: DataFrame, seed: int = 43, tokenizer: str | None = None) -> DataFrame:
    """(plan_id, source, target_share, max_repeats, size, wanted, reached_share, documents, tokens): what the mixture reaches of each target."""
    path = f"{shared_dir(docs.sparkSession).rstrip('/')}/shares-{uuid.uuid4().hex}"
    sized(docs, tokenizer).withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    got = _drawn(rows, targets, seed).groupBy(F.col("plan_id").alias("p"), F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("size") * F.col("copies")).alias("tokens"))
    plan = rates(targets, totals(rows))
    both = plan.join(got, (F.col("plan_id") == F.col("p")) & (F.col("source") == F.col("s")), "left")
    tokens = F.coalesce("tokens", F.lit(0))
    return both.select("plan_id", "source", "target_share", "max_repeats", "size", F.round("wanted", 6).alias("wanted"), F.round(F.when(F.col("t") > 0, tokens / F.col("t")), 6).alias("reached_share"), F.coalesce("documents", F.lit(0)).alias("documents"), tokens.alias("tokens"))
