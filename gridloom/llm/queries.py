"""The registered queries of this subpackage: each applies an operator, with its production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records of the varied subset: a twentieth of the collection.
SUBSET_PART = 20


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from .clusters import linked

    return linked(_table(spark, d, "annotated_embeddings"), "rec_id", 0.90, 3).select("cluster_id", F.col("id").alias("rec_id"))


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    from .clusters import describe

    return describe(_table(spark, d, "annotated_embeddings"), "rec_id", "label")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from .neighbours import nearest

    parts = []
    for name, key in (("annotated_embeddings", "rec_id"), ("genre_embeddings", "emb_id")):
        near = nearest(_table(spark, d, name), key, 5, 0.90)
        parts.append(near.select(F.lit(name).alias("collection"), F.least("id", "other").alias("id_lo"), F.greatest("id", "other").alias("id_hi")).distinct())
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from .quota import shortfalls

    return shortfalls(_table(spark, d, "genre_embeddings"), "emb_id", "genre", _table(spark, d, "genre_targets"))


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    from .quota import draw

    return draw(_table(spark, d, "genre_embeddings"), "emb_id", "genre", _table(spark, d, "genre_targets")).withColumnRenamed("id", "emb_id")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    from .quota import allocate, counts

    return allocate(_table(spark, d, "genre_targets"), counts(_table(spark, d, "genre_embeddings"), "emb_id", "genre")).drop("category")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from .varied import crowds

    return crowds(_table(spark, d, "genre_embeddings"), "emb_id", 0.995, 8, "genre").select("group_id", F.col("id").alias("emb_id"))


def p4_subset(spark: SparkSession, d: str) -> DataFrame:
    from .varied import subset

    rows = _table(spark, d, "genre_embeddings")
    return subset(rows, "emb_id", "genre", rows.count() // SUBSET_PART).select(F.col("id").alias("emb_id"), F.col("category").alias("genre"), "density")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from .overlap import overlaps

    pairs = overlaps(_table(spark, d, "annotated_embeddings"), "rec_id", 0.995)
    return pairs.select(F.least("train_id", "eval_id").alias("rec_lo"), F.greatest("train_id", "eval_id").alias("rec_hi")).distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    from .overlap import report

    return report(_table(spark, d, "annotated_embeddings"), "rec_id", 0.995)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from .leaks import found

    return found(_table(spark, d, "documents"), _table(spark, d, "eval_passages"))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    from .leaks import leaked_items

    return leaked_items(_table(spark, d, "documents"), _table(spark, d, "eval_passages"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from .mixing import unreachable

    return unreachable(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    from .mixing import mixture

    return mixture(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    from .mixing import shares

    return shares(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from .pii import find

    return find(_table(spark, d, "documents"), lexicon=_table(spark, d, "name_lexicon")).select(F.col("id").alias("doc_id"), "kind", "start_char").distinct()


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    from .pii import redact

    return redact(_table(spark, d, "documents"), lexicon=_table(spark, d, "name_lexicon")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_clusters, p2_found, p3_found, p3_sample, p3_report, p4_found, p4_subset, p5_found, p5_report, p6_found, p6_items, p7_found, p7_mixture, p7_shares, p8_found, p8_redacted)}

# ---------------------------------------------------------------------------------------------------
# SQL for what SQL expresses, brute force over all pairs included; the others are tested against brute force, an exact round trip or held-out accuracy.

_CANON = "nullif(regexp_replace(strip_accents(lower(replace({0}, '&', ' and '))), '[^\\p{{L}}\\p{{N}}]', '', 'g'), '')"
_USABLE = """len(embedding) = 4
    AND len(list_filter(embedding, lambda r: len(r) = 16 AND len(list_filter(r, lambda v: isfinite(v))) = 16)) = 4
    AND len(list_filter(flatten(embedding), lambda v: v <> 0)) > 0"""
_WANTED = f"""
WITH usable AS (
  SELECT emb_id AS id, min(genre) AS spelled FROM genre_embeddings WHERE emb_id IS NOT NULL AND genre IS NOT NULL AND {_USABLE} GROUP BY emb_id),
have AS (SELECT {_CANON.format('spelled')} AS category, count(*) AS available FROM usable GROUP BY 1 HAVING category IS NOT NULL),
size AS (SELECT coalesce(sum(available), 0) // 10 AS n FROM have),
wanted AS (
  SELECT plan_id, t.genre, {_CANON.format('t.genre')} AS category,
         greatest(coalesce(min_rows, 0), CAST(ceil(round(target_share * n, 6)) AS BIGINT)) AS wanted FROM genre_targets t, size)
"""
_SIZED = """
WITH sized AS (
  SELECT doc_id, lower(trim(source)) AS source, len(regexp_extract_all(text, '\\p{L}+|\\p{Nd}+|[^\\s\\v\\x{85}\\p{Z}\\p{L}\\p{Nd}]')) AS size
  FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND trim(source) <> ''),
per AS (SELECT source, sum(size) AS size FROM sized GROUP BY source),
total AS (SELECT coalesce(sum(size), 0) // 2 AS t FROM per)
"""
_MIXED = _SIZED + """,
plan AS (
  SELECT plan_id, m.source, lower(trim(m.source)) AS key, target_share, max_repeats, coalesce(size, 0) AS size, t, target_share * t AS wanted,
    CASE WHEN size > 0 THEN least(target_share * t / size, max_repeats) ELSE 0 END AS rate,
    CAST(('0x' || substr(md5('43:' || plan_id || ':' || lower(trim(m.source))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS offs
  FROM mix_targets m LEFT JOIN per ON lower(trim(m.source)) = per.source, total),
placed AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY md5('43:' || doc_id), doc_id) - 1 AS k FROM sized),
drawn AS (
  SELECT plan_id, p.source, doc_id, d.size, CAST(floor(round((k + 1) * rate + offs, 9)) - floor(round(k * rate + offs, 9)) AS BIGINT) AS copies
  FROM placed d JOIN plan p ON d.source = p.key WHERE rate > 0),
mixed AS (SELECT * FROM drawn WHERE copies > 0)
"""
#: The vectors of a table, one a record, with the numbers that its similarity needs.
_VECTORS = """SELECT {1} AS id, any_value(CAST(flatten(embedding) AS DOUBLE[64])) AS v FROM {0} WHERE {1} IS NOT NULL AND """ + _USABLE + " GROUP BY 1"
_LINKS = "SELECT a.id AS u, b.id AS v FROM vecs a JOIN vecs b ON a.id < b.id WHERE round(array_cosine_similarity(a.v, b.v), 9) >= {0}"


def _grouped(table: str, key: str, floor: float, least: int, name: str) -> str:
    """Groups reachable over links of all pairs."""
    return f"""
WITH RECURSIVE vecs AS MATERIALIZED ({_VECTORS.format(table, key)}),
links AS MATERIALIZED ({_LINKS.format(floor)}),
ways AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(id, root) AS (
  SELECT DISTINCT u, u FROM ways
  UNION
  SELECT b.v, r.root FROM reach r JOIN ways b ON b.u = r.id WHERE r.root < b.v),
rooted AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT root AS {name}, id AS {key} FROM rooted WHERE root IN (SELECT root FROM rooted GROUP BY root HAVING count(*) >= {least})"""


SQL: dict[str, str] = {
    "p1_found": _grouped("annotated_embeddings", "rec_id", 0.90, 3, "cluster_id"),
    "p3_found": _WANTED + "SELECT plan_id, genre FROM wanted LEFT JOIN have USING (category) WHERE wanted > coalesce(available, 0)",
    "p4_found": _grouped("genre_embeddings", "emb_id", 0.995, 8, "group_id"),
    "p7_found": _SIZED + "SELECT plan_id, m.source FROM mix_targets m LEFT JOIN per ON lower(trim(m.source)) = per.source, total WHERE target_share * t > max_repeats * coalesce(size, 0)",
    "p7_mixture": _MIXED + "SELECT plan_id, source, doc_id, size, copies FROM mixed",
    "p7_shares": _MIXED + """
SELECT p.plan_id, p.source, target_share, max_repeats, p.size, round(wanted, 6) AS wanted, round(coalesce(tokens, 0) / nullif(t, 0), 6) AS reached_share,
       coalesce(documents, 0) AS documents, coalesce(tokens, 0) AS tokens
FROM plan p LEFT JOIN (SELECT plan_id, source, count(*) AS documents, sum(size * copies) AS tokens FROM mixed GROUP BY ALL) g ON p.plan_id = g.plan_id AND p.source = g.source""",
}
