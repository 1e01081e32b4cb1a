"""Texts, logs, package lists, configurations and schedules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.functions import scalar, text
from gridloom.operators import logs as L
from gridloom.sources.grid import table
from gridloom.streaming import plateau as P

from .registry import SQL, query


@query("SELECT doc_id, regexp_replace(strip_accents(title), '[^\\x00-\\x7F]', '', 'g') AS plain, regexp_matches(title, '[^\\x00-\\x7F]') AS odd FROM documents WHERE title IS NOT NULL AND title <> ''")
def ascii_normalise(spark, d):
    rows = table(spark, d, "documents").filter("title is not null and title != ''")
    return rows.select("doc_id", text.ascii_fold("title").alias("plain"), text.has_non_ascii(F.col("title")).alias("odd"))


@query("SELECT condition, try_cast(split_part(condition, '_', -1) AS DOUBLE) AS seconds, CAST(count(*) AS BIGINT) AS n FROM metrics WHERE contains(condition, 'inpaint') GROUP BY 1")
def condition_context(spark, d):
    """The context that an inpainting condition names in its last part."""
    rows = table(spark, d, "metrics").filter(F.col("condition").contains("inpaint"))
    return rows.groupBy("condition").agg(F.count(F.lit(1)).alias("n")).select("condition", F.expr("try_cast(element_at(split(condition, '_'), -1) as double)").alias("seconds"), "n")


# Two blocks as the console prints them, one without sections and one that is valid again.
LOG = (
    "start\n[12:00:00] Iteration 10 train\n  loss │ 1.5 │ 0 \n  top 1/masked │ 0.25 │ 0.5 \n val\n  loss │ 2.5 │ 2.0 \n  other/x │ 3.5 │ nan \n"
    "[12:01:00] Iteration 11 nothing here\n[12:02:00] Iteration 12 train\n  loss │ 1.25 │ 1.4 \n val\n  loss │ nan │ 0 \n"
)
_LOG = LOG.replace("'", "''")
_SECT = "regexp_split_to_array(body, '\\btrain\\b|\\bval\\b')"
_LINE = "(?m)^\\s+(.*?)\\s+│\\s+([\\d\\.]+|nan)\\s+│\\s+([\\d\\.]+|nan)\\s+$"
_PULL = lambda g: f"unnest(regexp_extract_all(x, '{_LINE}', {g}))"


@query(f"""WITH b AS (SELECT unnest(range(1, 4)) AS block, unnest(regexp_split_to_array('{_LOG}', '\\[\\d{{2}}:\\d{{2}}:\\d{{2}}\\]')[2:]) AS body),
p AS (SELECT block, regexp_extract(body, 'Iteration (\\d+)', 1) AS iteration, {_SECT} AS s FROM b WHERE len({_SECT}) >= 3),
s AS (SELECT block, iteration, 'dataset' AS pre, s[2] AS x FROM p UNION ALL SELECT block, iteration, 'val', s[3] FROM p),
l AS (SELECT block, iteration, pre, {_PULL(1)} AS k, {_PULL(2)} AS v, {_PULL(3)} AS m FROM s),
r AS (SELECT block, iteration, pre || '_' || regexp_replace(k, '[ /]', '_', 'g') AS key, CASE WHEN m IN ('nan', '0') THEN v ELSE m END AS value FROM l)
SELECT CAST(dense_rank() OVER (ORDER BY block) AS INTEGER) AS "index", iteration, max(CASE WHEN key = 'dataset_loss' THEN value END) AS dataset_loss, max(CASE WHEN key = 'dataset_top_1_masked' THEN value END) AS dataset_top_1_masked,
max(CASE WHEN key = 'val_loss' THEN value END) AS val_loss, max(CASE WHEN key = 'val_other_x' THEN value END) AS val_other_x FROM r GROUP BY block, iteration""")
def log_parse_pivot(spark, d):
    """A console log in a file, read whole."""
    rows = L.parse_logs(_log_file(spark))
    return rows.groupBy("index", "iteration").pivot("key", ["dataset_loss", "dataset_top_1_masked", "val_loss", "val_other_x"]).agg(F.first("value"))


def _log_file(spark):
    from .io_queries import _folder

    folder = _folder(spark, "log")
    spark.createDataFrame([(LOG,)], "text string").coalesce(1).write.text(folder)
    return spark.read.text(folder, wholetext=True).select(F.lit("a").alias("run"), F.col("value").alias("text"))


@query(SQL["log_parse_pivot"].replace("CAST(dense_rank() OVER (ORDER BY block) AS INTEGER)", "CAST(dense_rank() OVER (ORDER BY block) AS VARCHAR)"))
def log_csv_roundtrip(spark, d):
    """The same log as a CSV with whatever columns it has, written and read again."""
    from gridloom.sources import sinks

    from .io_queries import _folder

    folder = _folder(spark, "log-csv")
    sinks.write_wide(L.parse_logs(_log_file(spark)), ["index", "iteration"], folder)
    return spark.read.option("header", True).csv(folder)


NEW, WORKING = ["Package Version", "------- -------", "Torch 2.1", "numpy 1.23", "# note", "yaml 6.0", "torch 2.2"], ["torch 2.0", "numpy 1.23", "yaml 5.4"]
_LINES = lambda rows: "(VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(rows)) + ") AS v(n, line)"
_VERS = lambda rows: f"(SELECT lower(split_part(line, ' ', 1)) AS module, arg_max(split_part(line, ' ', 2), n) AS version FROM {_LINES(rows)} WHERE NOT starts_with(line, '#') AND NOT starts_with(line, 'Package') AND NOT starts_with(line, '-') GROUP BY 1)"


@query(f"SELECT a.module || '==' || b.version AS requirement FROM {_VERS(NEW)} a JOIN {_VERS(WORKING)} b USING (module) WHERE a.version <> b.version")
def package_diff(spark, d):
    frame = lambda rows: L.package_versions(spark.createDataFrame(list(enumerate(rows)), "n int, line string"))
    return L.changed_packages(frame(NEW), frame(WORKING))


@query("SELECT CAST(event_id AS VARCHAR) AS key, event_type AS split, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def column_json_join(spark, d):
    """Column-oriented documents (two maps by row key, at most about 10 000 keys each) written as JSON files, read and turned into rows."""
    from .io_queries import _folder

    folder, e = _folder(spark, "columns"), table(spark, d, "events")
    parts = F.pmod(F.xxhash64("event_id"), F.lit(e.count() // 10_000 + 1))
    e = e.select(parts.alias("part"), F.col("event_id").cast("string").alias("key"), "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    documents = e.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("key", "event_type"))).alias("split"), F.map_from_entries(F.collect_list(F.struct("key", "k"))).alias("k"))
    documents.drop("part").write.option("ignoreNullFields", "false").json(folder)
    return L.join_columns(spark.read.schema("split map<string,string>, k map<string,int>").json(folder), "split", "k")


@query("SELECT event_type, round(avg(CAST(json_extract(props, '$.k') AS INTEGER)), 6) AS mean_k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def json_props(spark, d):
    rows = table(spark, d, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return rows.groupBy("event_type").agg(F.round(F.avg("p.k"), 6).alias("mean_k"), F.count(F.lit(1)).alias("n"))


# The eight presets (period, onset width, beat width, downbeats only).
PRESETS = [
    ("unconditional", 0, 0, 0, False), ("slight periodic variation", 5, 5, 0, False), ("moderate periodic variation", 13, 5, 0, False), ("strong periodic variation", 17, 5, 0, False),
    ("very strong periodic variation", 21, 5, 0, False), ("beat-driven variation", 0, 0, 50, False), ("beat-driven variation (downbeats only)", 0, 0, 50, True), ("beat-driven variation (downbeats only, strong)", 0, 0, 20, True),
]


@query("WITH p(preset, periodic_p, onset_mask_width, beat_mask_width, beat_mask_downbeats) AS (VALUES " + ", ".join(f"('{a}', {b}, {c}, {e}, {str(f).lower()})" for a, b, c, e, f in PRESETS) + ") SELECT preset, periodic_p, onset_mask_width, beat_mask_width, beat_mask_downbeats, CAST(count(*) AS BIGINT) AS conditions FROM p JOIN (SELECT DISTINCT condition FROM metrics) c ON condition = 'periodic_' || periodic_p OR (periodic_p = 0 AND starts_with(condition, 'beat_mask')) GROUP BY ALL")
def preset_lookup(spark, d):
    """Presets with the number of conditions that use their period, or beats where they have none."""
    p = spark.createDataFrame(PRESETS, "preset string, periodic_p int, onset_mask_width int, beat_mask_width int, beat_mask_downbeats boolean")
    c = table(spark, d, "metrics").select("condition").distinct().select(F.when(F.col("condition").startswith("beat_mask"), 0).otherwise(F.expr("try_cast(substring_index(condition, 'periodic_', -1) as int)")).alias("periodic_p"), "condition")
    c = c.filter(F.col("condition").startswith("beat_mask") | F.col("condition").startswith("periodic_"))
    return p.join(c, "periodic_p").groupBy(*p.columns).agg(F.count(F.lit(1)).alias("conditions"))


BASE = [("", "Model.n_codebooks", "4"), ("", "Model.n_layers", "20"), ("", "vocab_size", "1024"), ("train", "AudioDataset.duration", "10.0"), ("", "AudioLoader.loudness_cutoff", "-30")]
OVER = [("", "Model.n_codebooks", "14"), ("", "Model.n_layers", "16"), ("train", "AudioDataset.duration", "3.0"), ("", "AudioLoader.loudness_cutoff", "-40")]
_CFG = lambda rows: "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in rows) + ") AS v(scope, key, value)"


@query(f"SELECT scope, key, coalesce(o.value, b.value) AS value FROM (SELECT * FROM {_CFG(BASE)}) b FULL JOIN (SELECT * FROM {_CFG(OVER)}) o USING (scope, key)")
def config_overlay(spark, d):
    schema = "scope string, key string, value string"
    return L.merge_maps(spark.createDataFrame(BASE, schema), spark.createDataFrame(OVER, schema))


@query("WITH s AS (SELECT unnest(range(1, 5001)) AS step) SELECT step, round(2.0 * pow(1280, -0.5) * least(pow(step, -0.5), step * pow(1000, -1.5)), 9) AS lr FROM s")
def noam_lr(spark, d):
    return spark.range(1, 5001).select(F.col("id").alias("step"), F.round(scalar.noam_rate(F.col("id"), 1280, 1000, 2.0), 9).alias("lr"))


@query("WITH s AS (SELECT unnest(range(1, 5001)) AS step) SELECT round(16 * sum(2.0 * pow(1280, -0.5) * least(pow(step, -0.5), step * pow(1000, -1.5))), 6) AS total, round(max(2.0 * pow(1280, -0.5) * least(pow(step, -0.5), step * pow(1000, -1.5))), 9) AS peak FROM s")
def noam_total(spark, d):
    lr = scalar.noam_rate(F.col("id"), 1280, 1000, 2.0)
    return spark.range(1, 5001).agg(F.round(F.sum(lr) * 16, 6).alias("total"), F.round(F.max(lr), 9).alias("peak"))


@query("WITH s AS (SELECT unnest(range(1, 33)) AS target) SELECT target, round(2.0 * sqrt(16.0 / target), 9) AS factor, round_even(2.0 * sqrt(16.0 / target), 1) AS stored_factor, CAST(trunc(12345 * (16.0 / target)) AS BIGINT) AS step FROM s")
def noam_rescale(spark, d):
    """Factor and step after a change of the batch size from 16."""
    ratio = F.lit(16.0) / F.col("id")
    return spark.range(1, 33).select(F.col("id").alias("target"), F.round(F.sqrt(ratio) * 2.0, 9).alias("factor"), F.bround(F.sqrt(ratio) * 2.0, 1).alias("stored_factor"), (ratio * 12345).cast("bigint").alias("step"))


_EVEN = lambda x, m: f"CAST({m} * round_even(({x}) / CAST({m} AS DOUBLE), 0) AS BIGINT)"
_EPOCH = f"""WITH n AS (SELECT label, count(DISTINCT clip_id) AS samples FROM clips WHERE label IS NOT NULL AND clip_id IS NOT NULL GROUP BY 1),
i AS (SELECT label, samples, samples // 2 AS per_epoch FROM n),
f AS (SELECT *, CAST(round_even(0.5 * per_epoch, 0) AS BIGINT) AS val_freq, CAST(round_even(1.5 * per_epoch, 0) AS BIGINT) AS sample_freq FROM i),
l AS (SELECT *, nullif(lcm(val_freq, sample_freq), 0) AS grid FROM f), e AS (SELECT *, unnest([5, 10, 20]) AS epochs FROM l),
s AS (SELECT *, {_EVEN('per_epoch * epochs', 'nullif(val_freq, 0)')} AS first_save FROM e)
SELECT label, CAST(samples AS BIGINT) AS samples, CAST(per_epoch AS BIGINT) AS per_epoch, val_freq, sample_freq, CAST(epochs AS INTEGER) AS epochs, {_EVEN('first_save', 'grid')} AS save_iter FROM s"""


@query(_EPOCH)
def epoch_plan(spark, d):
    """Iterations, frequencies and save points, rounded to the grid of both frequencies."""
    n = table(spark, d, "clips").filter("label is not null and clip_id is not null").groupBy("label").agg(F.countDistinct("clip_id").alias("samples"))
    per = F.floor(F.col("samples") / 2).cast("bigint")
    rows = n.withColumn("per_epoch", per).withColumn("val_freq", F.bround(F.col("per_epoch") * 0.5, 0).cast("bigint")).withColumn("sample_freq", F.bround(F.col("per_epoch") * 1.5, 0).cast("bigint"))
    # the greatest common divisor by Euclid, as a fold whose length bounds the steps for 64-bit numbers
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(F.col("val_freq").alias("a"), F.col("sample_freq").alias("b")), lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("bigint")).otherwise(s["a"] % F.greatest(s["b"], F.lit(1))).alias("b")), lambda s: s["a"])
    # a label of so few clips that a frequency is 0 has no save points
    none = lambda c: F.when(F.col(c) > 0, F.col(c))
    rows = rows.withColumn("grid", (none("val_freq") * none("sample_freq") / F.greatest(gcd, F.lit(1))).cast("bigint")).withColumn("epochs", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20))))
    first = (F.bround(F.col("per_epoch") * F.col("epochs") / none("val_freq"), 0) * F.col("val_freq")).cast("bigint")
    return rows.withColumn("s", first).select("label", "samples", "per_epoch", "val_freq", "sample_freq", "epochs", (F.bround(F.col("s") / F.col("grid"), 0) * F.col("grid")).cast("bigint").alias("save_iter"))


def _metric_stream(e):
    return e.select((F.col("user_id") % 4).cast("string").alias("run"), F.col("event_id").alias("step"), (F.col("value") / 10).alias("loss"), F.when(F.col("event_id") % 5 == 0, F.col("value") / 90).alias("grad"))


_PLATEAU = """WITH RECURSIVE r AS (SELECT CAST(user_id % 4 AS VARCHAR) AS run, event_id AS step, value / 10 AS loss, CASE WHEN event_id % 5 = 0 THEN value / 90 END AS grad, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS i FROM events WHERE value IS NOT NULL),
f AS (
  SELECT DISTINCT run, 0::BIGINT AS i, NULL::BIGINT AS step, 10.0::DOUBLE AS best, NULL::DOUBLE AS previous, 0::BIGINT AS bad, 0.001::DOUBLE AS lr FROM r
  UNION ALL
  SELECT run, i, step, best, CASE WHEN grad IS NOT NULL THEN grad ELSE previous END, CASE WHEN steep OR bad > 10 THEN 0 ELSE bad END,
         CASE WHEN steep OR bad > 10 THEN greatest(lr * 0.5, 1e-6) ELSE lr END
  FROM (SELECT r.run, r.i, r.step, CASE WHEN r.loss < b0 * 0.999 THEN r.loss ELSE b0 END AS best, CASE WHEN r.loss < b0 * 0.999 THEN 0 ELSE q.bad + 1 END AS bad, q.previous, q.lr, r.grad,
        coalesce(r.grad IS NOT NULL AND q.previous IS NOT NULL AND (r.grad > 1.0 OR r.grad > 2 * q.previous), false) AS steep
        FROM (SELECT *, CASE WHEN best = 0 THEN 10.0 ELSE best END AS b0 FROM f) q JOIN r ON r.run = q.run AND r.i = q.i + 1))
SELECT run, step, round(best, 9) AS best, CAST(bad AS BIGINT) AS bad, round(lr, 12) AS lr FROM f WHERE i > 0"""


def _rounded(df):
    return df.select("run", "step", F.round("best", 9).alias("best"), "bad", F.round("lr", 12).alias("lr"))


@query(_PLATEAU)
def plateau_fold(spark, d):
    """The plateau schedule over four ordered metric streams."""
    return _rounded(P.fold(_metric_stream(table(spark, d, "events").filter("value is not null"))))


@query(_PLATEAU)
def plateau_stream(spark, d):
    """The same schedule as the state of a stream, read and written anew in the shared folder."""
    from .shared import ensure_checkpoint_dir

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/plateau-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return _rounded(P.available(P.stream(_metric_stream(source.filter("value is not null"))), base + "/out", base + "/state"))


@query("SELECT event_id AS step, event_id % 100 = 0 OR event_id = (SELECT max(event_id) FROM events) AS sample, event_id % 250 = 0 OR event_id = (SELECT max(event_id) FROM events) AS validate FROM events WHERE event_id % 50 = 0 OR event_id = (SELECT max(event_id) FROM events)")
def every_n_trigger(spark, d):
    """Steps at which something is due; the last one always."""
    e = table(spark, d, "events").select(F.col("event_id").alias("step"))
    last = e.agg(F.max("step").alias("last"))
    rows = e.crossJoin(F.broadcast(last))  # one row
    due = lambda n: (F.col("step") % n == 0) | (F.col("step") == F.col("last"))
    return rows.filter(due(50)).select("step", due(100).alias("sample"), due(250).alias("validate"))


@query("WITH r AS (SELECT user_id % 4 AS run, event_id, value, min(value) OVER (PARTITION BY user_id % 4 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM events) SELECT run, event_id, round(least(value, past), 9) AS best, coalesce(value < past, value IS NOT NULL) AS is_best FROM r")
def best_so_far(spark, d):
    rows = table(spark, d, "events").select((F.col("user_id") % 4).alias("run"), "event_id", "value")
    return P.best_so_far(rows, ["run"], "event_id", "value", 1000.0).select("run", "event_id", F.round("best", 9).alias("best"), "is_best")


@query("SELECT event_id // 500 AS span, round(avg(value), 6) AS mean_norm FROM events GROUP BY 1")
def mean_norm_between(spark, d):
    """The mean of a norm between one validation and the next."""
    return table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 500).alias("span")).agg(F.round(F.avg("value"), 6).alias("mean_norm"))
