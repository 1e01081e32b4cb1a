"""A sample whose categories match target shares, allocated top-down over a category tree and drawn at the leaves.

Categories are equal when they differ only in letter case, blanks, punctuation, accents or `&` for `and`. A plan wants
max(min_rows, ceil(target_share * sample size)) records of each category. The tree is a table (category, parent); without one, a
category stands below the longest other one that its name ends with (`acid jazz` below `jazz`), else below the root. Quotas are
set at the root and handed down: a node's quota is split among its children by what their subtrees want and have; what one
cannot supply goes to its siblings, and what all of them cannot to their parent's siblings, whose children are cousins. At a
leaf the records of lowest permuted dense rank are drawn.

Rows with a null id, a null or blank category or no usable vector are not considered; a record delivered twice is one.
An empty table gives a sample size of zero. A plan is allocated in one task of its own, which holds its rows.
"""

from __future__ import annotations

import unicodedata
import uuid

import pandas as pd
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .vectors import is_usable as usable
from .vectors import shared_dir

#: Records of a category that are ranked in one task, about.
RANGE_ROWS = 20_000


def canonical(text: str | None) -> str | None:
    """The category that a spelling means, or None for null and blank ones."""
    if text is None:
        return None
    plain = unicodedata.normalize("NFKD", text.replace("&", " and ").casefold())
    out = "".join(c for c in plain if c.isalnum() and not unicodedata.combining(c))
    return out or None


@F.pandas_udf(T.StringType())
def canonical_udf(s: pd.Series) -> pd.Series:
    known = {x: canonical(x) for x in s.unique()}
    return s.map(known)


def considered(df: DataFrame, id_col: str, category_col: str) -> DataFrame:
    """(id, category), one row a record."""
    rows = df.filter(F.col(id_col).isNotNull() & F.col(category_col).isNotNull() & usable()).select(F.col(id_col).alias("id"), F.col(category_col).alias("spelled"))
    rows = rows.groupBy("id").agg(F.min("spelled").alias("spelled"))
    # a spelling is made canonical once, not once a row
    spelled = rows.groupBy("spelled").agg(F.count(F.lit(1)).alias("n")).withColumn("category", canonical_udf("spelled"))
    return rows.join(spelled.filter(F.col("category").isNotNull()).select("spelled", "category"), "spelled").select("id", "category")


def counts(df: DataFrame, id_col: str, category_col: str) -> DataFrame:
    """(category, available) without a join over the records: spellings are counted first, then made canonical."""
    rows = df.filter(F.col(id_col).isNotNull() & F.col(category_col).isNotNull() & usable()).select(F.col(id_col).alias("id"), F.col(category_col).alias("spelled"))
    spelled = rows.groupBy("id").agg(F.min("spelled").alias("spelled")).groupBy("spelled").agg(F.count(F.lit(1)).alias("n"))
    return spelled.withColumn("category", canonical_udf("spelled")).filter(F.col("category").isNotNull()).groupBy("category").agg(F.sum("n").alias("available"))


def wishes(plan: DataFrame, available: DataFrame, fraction: int = 10) -> DataFrame:
    """The plan's rows with wanted and available. The sample size is floor(records / fraction)."""
    size = available.agg(F.floor(F.coalesce(F.sum("available"), F.lit(0)) / fraction).alias("sample_size"))
    plan = plan.select("plan_id", "genre", "target_share", "min_rows", canonical_udf("genre").alias("category"))
    joined = plan.join(available, "category", "left").crossJoin(F.broadcast(size))  # one row
    # the share is decimal in the plan, so its product is rounded before the ceiling
    share = F.ceil(F.round(F.col("target_share") * F.col("sample_size"), 6))
    return joined.select("plan_id", "genre", "category", F.greatest(F.coalesce("min_rows", F.lit(0)).cast("bigint"), F.coalesce(share, F.lit(0))).alias("wanted"), F.coalesce("available", F.lit(0)).alias("available"), "sample_size")


def words_tree(categories: list[tuple[str, str]]) -> dict[str, str]:
    """Parent by canonical category of (category, spelling) pairs, from the words of the spellings; those without one are missing."""
    words = {c: [w for w in (canonical(x) for x in re.split(r"[\s_\-]+", s or "")) if w] for c, s in categories if c}
    out = {}
    for c, own in words.items():
        ends = [d for d in ("".join(own[k:]) for k in range(1, len(own))) if d in words and d != c]
        if ends:
            out[c] = max(ends, key=len)
    return out


def hand_down(rows: list[dict], parent: dict[str, str]) -> list[dict]:
    """Adds `granted` and `unmet` to the rows of one plan (category, wanted, available). Quotas go from the root down the tree."""
    children: dict[str, list[str]] = {}
    at: dict[str, list[dict]] = {}
    for k, r in enumerate(rows):
        at.setdefault(r["category"] or f"?{k}", []).append(r)
    known = set()
    for c in at:  # a chain of parents that runs in a circle ends below the root
        path = [c]
        while path[-1] in parent and parent[path[-1]] not in path:
            path.append(parent[path[-1]])
        for low, high in zip(path, [*path[1:], ""]):
            if low not in known:
                known.add(low)
                children.setdefault(high, []).append(low)

    totals: dict[str, tuple[int, int]] = {}

    def below(node: str) -> tuple[int, int]:
        """What a subtree wants and has."""
        if node not in totals:
            parts = [below(c) for c in children.get(node, ())]
            own = at.get(node, ())
            # spellings of one category share its records
            totals[node] = (sum(p[0] for p in parts) + sum(r["wanted"] for r in own), sum(p[1] for p in parts) + max([r["available"] for r in own], default=0))
        return totals[node]

    def split(wants: list[int], has: list[int], quota: int) -> list[int]:
        """Shares of a quota: first what each wants and has, then what is unmet to those with room, by their wishes."""
        got = [min(w, h) for w, h in zip(wants, has)]
        while sum(got) > quota:  # less than all want: the largest give way
            k = max(range(len(got)), key=lambda k: got[k])
            got[k] -= sum(got) - quota if got[k] >= sum(got) - quota else got[k]
        unmet = quota - sum(got)
        while unmet > 0 and (room := [k for k in range(len(got)) if has[k] > got[k]]):
            weight, before = sum(max(1, wants[k]) for k in room), unmet
            for k in sorted(room, key=lambda k: -wants[k]):
                more = min(unmet, has[k] - got[k], max(1, before * max(1, wants[k]) // weight))
                got[k] += more
                unmet -= more
        return got

    def allot(node: str, quota: int) -> None:
        kids = children.get(node, [])
        own = at.get(node, [])
        mine = [max([r["available"] for r in own], default=0)] if own else []
        shares = split([below(c)[0] for c in kids] + ([sum(r["wanted"] for r in own)] if own else []), [below(c)[1] for c in kids] + mine, quota)
        for c, q in zip(kids, shares):
            allot(c, q)
        if own:
            left = shares[-1]
            for k, r in enumerate(own):
                r["granted"] = left if k == len(own) - 1 else min(r["wanted"], left)
                left -= r["granted"]

    allot("", below("")[0])
    for r in rows:
        r["unmet"] = max(0, r["wanted"] - r["granted"])
    return rows


_REPORT = "plan_id int, genre string, category string, wanted bigint, available bigint, granted bigint, unmet bigint"


def allocate(plan: DataFrame, available: DataFrame, fraction: int = 10, tree: DataFrame | None = None) -> DataFrame:
    """(plan_id, genre, category, wanted, available, granted, unmet), the report of a plan. tree is a table (category, parent)."""
    wanted = wishes(plan, available, fraction).select("plan_id", "genre", "category", "wanted", "available")
    parents = None
    if tree is not None:
        edges = tree.select(canonical_udf("category").alias("category"), canonical_udf("parent").alias("parent")).filter("category is not null and parent is not null")
        wanted = wanted.withColumn("parent", F.lit(None).cast("string")).unionByName(wanted.select("plan_id").distinct().crossJoin(edges).select("plan_id", F.lit(None).cast("string").alias("genre"), "category", F.lit(-1).cast("bigint").alias("wanted"), F.lit(0).cast("bigint").alias("available"), "parent"))  # the tree goes with each plan
        parents = True

    def of_plan(table: pa.Table) -> pa.Table:
        every = sorted(table.to_pylist(), key=lambda r: (r["genre"] is None, r["genre"] or "", r["wanted"]))
        rows = [r for r in every if r["wanted"] >= 0]
        parent = {r["category"]: r["parent"] for r in every if r["wanted"] < 0} if parents else words_tree([(r["category"], r["genre"]) for r in rows])
        return pa.Table.from_pylist([{k: r[k] for k in _SCHEMA.names} for r in hand_down(rows, parent)], _SCHEMA)

    return wanted.groupBy("plan_id").applyInArrow(of_plan, _REPORT)


_SCHEMA = pa.schema([("plan_id", pa.int32()), ("genre", pa.string()), ("category", pa.string()), ("wanted", pa.int64()), ("available", pa.int64()), ("granted", pa.int64()), ("unmet", pa.int64())])


def draw(df: DataFrame, id_col: str, category_col: str, plan: DataFrame, fraction: int = 10, seed: int = 23, tree: DataFrame | None = None) -> DataFrame:
    """(plan_id, genre, id): for each plan and category the `granted` records of lowest permuted dense rank."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/quota-{uuid.uuid4().hex}"
    allocate(plan, counts(df, id_col, category_col), fraction, tree).write.parquet(path)
    report = df.sparkSession.read.parquet(path).filter("granted > 0")
    most = report.groupBy("category").agg(F.max("granted").alias("most"))
    rows = considered(df, id_col, category_col).join(most, "category")
    # the permutation is the order of a hash; ranges of it, as many as the count asks for, are ranked apart
    ranges = max(16, df.count() // RANGE_ROWS)
    keyed = rows.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))))
    keyed = keyed.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * ranges / F.lit(1 << 32)))
    sizes = keyed.groupBy("category", "range").agg(F.count(F.lit(1)).alias("n"), F.first("most").alias("most"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("category").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # ranges beyond what is granted are left before anything is sorted
    wanted = keyed.drop("most").join(before.filter("before < most").select("category", "range", "before"), ["category", "range"])
    ranked = wanted.withColumn("rank", F.col("before") + F.dense_rank().over(W.partitionBy("category", "range").orderBy("key", "id")))
    return ranked.join(report.select("plan_id", "genre", "category", "granted"), "category").filter(F.col("rank") <= F.col("granted")).select("plan_id", "genre", "id")


def shortfalls(df: DataFrame, id_col: str, category_col: str, plan: DataFrame, fraction: int = 10, tree: DataFrame | None = None) -> DataFrame:
    """(plan_id, genre): rows of the plan of which the sample holds fewer records than wanted."""
    wanted = wishes(plan, counts(df, id_col, category_col), fraction).select("plan_id", "genre", "wanted")
    got = draw(df, id_col, category_col, plan, fraction, tree=tree).groupBy(F.col("plan_id").alias("p"), F.col("genre").alias("g")).agg(F.count(F.lit(1)).alias("got"))
    both = wanted.join(got, (F.col("plan_id") == F.col("p")) & F.col("genre").eqNullSafe(F.col("g")), "left")
    return both.filter(F.col("wanted") > F.coalesce("got", F.lit(0))).select("plan_id", "genre")
