"""Training logs, package lists, nested maps and configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The forms of the console logs.
STAMP = r"\[\d{2}:\d{2}:\d{2}\]"
SECTION = r"\btrain\b|\bval\b"
LINE = r"(?m)^\s+(.*?)\s+│\s+([\d\.]+|nan)\s+│\s+([\d\.]+|nan)\s+$"


def parse_logs(logs: DataFrame, text: str = "text", run: str = "run") -> DataFrame:
    """(run, index, iteration, key, value) of whole log texts: one row a metric of every stamped block that has any.

    A block needs an iteration and two sections. The value is the mean unless that is nan or the literal 0, then the current
    one; keys get dataset_ or val_ in front and no blanks or slashes; a repeated key keeps its last value. Blocks that yield
    nothing are not counted by index.
    """
    blocks = logs.select(run, F.posexplode(F.split(text, STAMP)).alias("block", "body")).filter("block > 0")
    parts = blocks.select(run, "block", F.regexp_extract("body", r"Iteration (\d+)", 1).alias("iteration"), F.split("body", SECTION).alias("s")).filter((F.col("iteration") != "") & (F.size("s") >= 3))
    sides = parts.select(run, "block", "iteration", F.explode(F.array(F.struct(F.lit("dataset").alias("p"), F.col("s")[1].alias("x")), F.struct(F.lit("val").alias("p"), F.col("s")[2].alias("x")))).alias("side"))
    pull = lambda g: F.regexp_extract_all("side.x", F.lit(LINE), g)
    lines = sides.select(run, "block", "iteration", F.col("side.p").alias("p"), F.posexplode(F.arrays_zip(pull(1).alias("k"), pull(2).alias("v"), pull(3).alias("m"))).alias("at", "l"))
    use_mean = ~F.col("l.m").isin("nan", "0")
    key = F.concat(F.col("p"), F.lit("_"), F.regexp_replace("l.k", "[ /]", "_"))
    rows = lines.groupBy(run, "block", "iteration", key.alias("key")).agg(F.max_by(F.when(use_mean, F.col("l.m")).otherwise(F.col("l.v")), "at").alias("value"))
    valid = rows.select(run, "block").distinct().withColumn("index", F.row_number().over(W.partitionBy(run).orderBy("block")))
    return rows.join(valid, [run, "block"]).select(run, "index", "iteration", "key", "value")


def package_versions(lines: DataFrame, line: str = "line", number: str = "n") -> DataFrame:
    """(module, version) of a package list: comments, headings and rules skipped, names in lower case, the last of a name wins."""
    text = F.trim(line)
    rows = lines.filter((text != "") & ~text.startswith("#") & ~text.startswith("Package") & ~text.startswith("-"))
    parts = F.split(text, r"\s+")
    rows = rows.filter(F.size(parts) >= 2).select(F.lower(parts[0]).alias("module"), parts[1].alias("version"), number)
    return rows.groupBy("module").agg(F.max_by("version", number).alias("version"))


def changed_packages(new: DataFrame, working: DataFrame) -> DataFrame:
    """(requirement): the working version of every module whose version differs."""
    both = new.withColumnRenamed("version", "v1").join(working.withColumnRenamed("version", "v2"), "module")
    return both.filter("v1 != v2").select(F.concat("module", F.lit("=="), "v2").alias("requirement"))


def join_columns(document: DataFrame, left: str, right: str) -> DataFrame:
    """(key, left, right) of a column-oriented document whose columns are maps by row key."""
    a = document.select(F.explode(left).alias("key", left))
    return a.join(document.select(F.explode(right).alias("key", right)), "key")


def merge_maps(base: DataFrame, over: DataFrame, keys: tuple[str, ...] = ("scope", "key")) -> DataFrame:
    """Settings (keys, value) of base with those of over in their place; a null in over removes."""
    new = over.withColumnRenamed("value", "__new").withColumn("__has", F.lit(True))
    rows = base.join(new, list(keys), "full")
    return rows.withColumn("value", F.when(F.col("__has"), F.col("__new")).otherwise(F.col("value"))).filter(F.col("value").isNotNull()).select(*keys, "value")
