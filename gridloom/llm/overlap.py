"""Same or near-same records across splits: hashes of canonicalised records, joined between evaluation and training.

Two canonical forms are hashed. A file name is stripped of folder, extension and copy marks and compared without case,
accents and word separators; its hash is the canonical name itself, made once for each distinct name. A vector is scaled to
length one; its hash is the nearest of centres fitted on a bounded sample, as many as the count of rows asks for. A training
record has this one hash; an evaluation record takes the hashes of all centres that a record within the bound may be nearest to
as well (two such vectors differ by a chord of known length), so no pair is lost, whatever the centres are. Pairs that share
a hash are then compared exactly. A hash of many records is cut into parts of either side, and a task compares two parts.

Records of a null or unknown split are in no pair; null names match nothing; a record delivered twice is one. Empty tables
give empty results.
"""

from __future__ import annotations

import unicodedata
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectors as V
from .quota import usable

# Spellings of splits, audio extensions, and the words that copies are marked with.
TRAIN, EVAL = ("train",), ("validation", "val", "test")
_EXTENSION = re.compile(r"\.(?:wav|wave|mp3|mp4|m4a|m4b|flac|ogg|oga|opus|aac|aif|aiff|aifc|wma|alac|caf|webm|au|w64|mka)$")
_MARK = re.compile(
    r"(?:\s*[(\[]\s*\d{1,3}\s*[)\]]"
    r"|\s(?:copy|copie|kopie|copia|kopia|copia de seguridad|duplicate|duplicato|duplikat)(?:\s*[(\[]?\s*\d{1,2}\s*[)\]]?)?"
    r"|\s[(\[]\s*(?:copy|copie|kopie|copia|kopia)(?:\s*\d{1,2})?\s*[)\]])$"
)
_LEADING = re.compile(r"^(?:copy of|copy \(\d+\) of|kopie von|copie de|copia de)\s+")
#: Rows of the sample that centres and parts are planned from, at least, and rows that a centre is planned for.
SAMPLE_ROWS, CENTRE_ROWS = 20_000, 1024


#: Records of one name beyond which it is salted.
HOT_NAME = 20_000


def canonical_name(name: str | None) -> str | None:
    """The file that a name means, or None for null names and names without any letter or digit."""
    if name is None:
        return None
    text = unicodedata.normalize("NFKD", re.split(r"[/\\]", name.strip())[-1]).casefold()
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    text = _EXTENSION.sub("", text.strip())
    text = re.sub(r"[\s_\p{Pd}]+", " ", text).strip()
    while True:
        shorter = _LEADING.sub("", _MARK.sub("", text)).strip()
        if shorter == text or not shorter:
            break
        text = shorter
    return text if any(c.isalnum() for c in text) else None


@F.pandas_udf(T.StringType())
def canonical_name_udf(s: pd.Series) -> pd.Series:
    return s.map(canonical_name)


def split_side(column: str = "split") -> F.Column:
    """0 for the training split, 1 for validation and test, null for others."""
    name = F.lower(F.trim(F.col(column)))
    return F.when(name.isin(*TRAIN), 0).when(name.isin(*EVAL), 1).cast("tinyint")


def by_vector(df: DataFrame, id_col: str, floor: float = 0.995) -> DataFrame:
    """(train_id, eval_id) of a similarity of at least floor, by shared hashes of unit vectors."""
    known = df.withColumn("side", split_side()).filter(F.col("side").isNotNull())
    total = known.count()
    count = V.cells_for(total, CENTRE_ROWS)
    sample = V.sample_vectors(known, id_col, max(SAMPLE_ROWS, V.PER_CELL * count), total)
    centres = V.merge_close(V.fit_cells(sample, count), sample, total, near=floor)
    reach = (2 - 2 * floor) ** 0.5 + 1e-5

    def hashes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash): the nearest centre of each row, and all beyond whose bisecting plane a record within reach may lie."""
        rows, cells = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo in range(0, len(y), 1024):
            s = y[lo : lo + 1024] @ centres.T
            home = s.argmax(1)
            apart = np.sqrt(np.maximum(2 - 2 * (centres[home] @ centres.T), 0) + 1e-6)
            r, c = np.nonzero(s.max(1)[:, None] - s <= reach * apart + 1e-5)
            rows.append(r + lo)
            cells.append(c)
        return np.concatenate(rows), np.concatenate(cells)

    train_parts = eval_parts = np.ones(len(centres), np.int64)
    if len(sample):
        y, share = V.unit(sample), total / len(sample)
        # the sample does not say its splits, so either side is planned as if it held all
        train_parts = V.parts_for(V.shares(y, centres), len(centres), share)
        eval_parts = V.parts_for(hashes(y)[1], len(centres), share)

    def spread(ids, sides, x, y):
        train, held = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        c = V.shares(y[train], centres)
        # a part of one side meets every part of the other
        own, times = V.salt_of(ids[train], train_parts[c]).astype(np.int64), eval_parts[c]
        a = np.repeat(np.arange(len(train)), times)
        task_a = own[a] * times[a] + np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)
        r, e = hashes(y[held])
        own, times = V.salt_of(ids[held][r], eval_parts[e]).astype(np.int64), train_parts[e]
        b = np.repeat(np.arange(len(r)), times)
        task_b = (np.arange(len(b)) - np.repeat(np.cumsum(times) - times, times)) * eval_parts[e][b] + own[b]
        side = np.concatenate([np.zeros(len(a), np.int8), np.ones(len(b), np.int8)])
        return np.concatenate([train[a], held[r[b]]]), np.concatenate([c[a], e[b]]), np.concatenate([task_a, task_b]), side

    def compare(table: pa.Table) -> pa.Table:
        ids, sides, x, y = V.group_rows(table)
        train, held = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        out_t, out_e = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(train) and len(held):
            for a, b in V.links(y[held], y[train], x[held], x[train], floor):
                out_e.append(ids[held[a]])
                out_t.append(ids[train[b]])
        return pa.table({"train_id": np.concatenate(out_t), "eval_id": np.concatenate(out_e)})

    side = "CASE WHEN lower(trim(split)) = 'train' THEN 0 ELSE 1 END"
    rows = V.staged(known, id_col, spread, side)
    return rows.groupBy("cell", "task").applyInArrow(compare, "train_id bigint, eval_id bigint").distinct()


def by_name(df: DataFrame, id_col: str) -> DataFrame:
    """(train_id, eval_id) whose names mean the same file and of which at least one has no usable vector.

    A name that many records share pairs them all, as the result asks for; the records of a hot name are salted on one side and
    meet on the other by every salt, so its pairs are made in many tasks.
    """
    rows = df.filter(F.col(id_col).isNotNull() & F.col("filename").isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), split_side().alias("side"), usable().alias("vec"), "filename")
    rows = rows.filter(F.col("side").isNotNull()).groupBy("id").agg(F.min("side").alias("side"), F.max("vec").alias("vec"), F.min("filename").alias("filename"))
    # only names of records without a vector can pair; a name is made canonical once, and joined by its hash
    path = f"{V.shared_dir(df.sparkSession).rstrip('/')}/names-{uuid.uuid4().hex}"
    names = rows.groupBy("filename").agg(F.count(F.lit(1)).alias("n")).withColumn("name", canonical_name_udf("filename")).filter(F.col("name").isNotNull())
    rows.join(names.select("filename", "name"), "filename").select("id", "side", "vec", "name", F.xxhash64("name").alias("h")).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    bare = rows.filter(~F.col("vec"))
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).join(bare.select("h").distinct(), "h").filter(F.col("n") > HOT_NAME)
    salts = F.least(F.lit(256), F.ceil(F.col("n") / HOT_NAME)).cast("int")
    salted = rows.join(often.select("h", salts.alias("salts")), "h", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    train = salted.filter("side = 0").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).select("h", "salt", "name", F.col("id").alias("train_id"), F.col("vec").alias("train_vec"))
    held = salted.filter("side = 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("h", "salt", "name", F.col("id").alias("eval_id"), F.col("vec").alias("eval_vec"))
    # a pair has a record without a vector, so two narrow joins replace one of all with all
    one = train.filter("not train_vec").join(held, ["h", "salt", "name"])
    other = train.filter("train_vec").join(held.filter("not eval_vec"), ["h", "salt", "name"])
    return one.select("train_id", "eval_id").unionByName(other.select("train_id", "eval_id"))


def overlaps(df: DataFrame, id_col: str = "rec_id", floor: float = 0.995) -> DataFrame:
    """(train_id, eval_id, by): all cross-split pairs, `by` being vector or filename."""
    return by_vector(df, id_col, floor).withColumn("by", F.lit("vector")).unionByName(by_name(df, id_col).withColumn("by", F.lit("filename")))


def report(df: DataFrame, id_col: str = "rec_id", floor: float = 0.995) -> DataFrame:
    """(split, source, by, eval_records, pairs): overlaps counted per split and source of the evaluation record."""
    name = F.lower(F.trim(F.col("split")))
    of = df.filter(split_side() == 1).groupBy(F.col(id_col).cast("bigint").alias("eval_id")).agg(F.min(F.when(name == "val", "validation").otherwise(name)).alias("split"), F.min(F.lower(F.trim("source"))).alias("source"))
    pairs = overlaps(df, id_col, floor).groupBy("eval_id", "by").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(of, "eval_id").groupBy("split", "source", "by").agg(F.count(F.lit(1)).alias("eval_records"), F.sum("n").alias("pairs"))
