"""Beats, sampling, schedules, preparation, files: small cases worked out by hand or restated in plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import config, scalar, text
from gridloom.operators import beats as B
from gridloom.operators import logs as L
from gridloom.operators import metrics, ordered, prep
from gridloom.operators import sampling as S
from gridloom.streaming import plateau as P


def test_segments_and_containment(spark):
    beats = spark.createDataFrame([(1, 1.0, False), (1, 2.0, True), (1, 3.0, False), (1, -1.0, True), (1, 9.0, False)], "clip_id bigint, beat_s double, is_downbeat boolean")
    got = [tuple(r)[1:] for r in B.segments(beats, spark.createDataFrame([(1, 4.0)], "clip_id bigint, end_s double"), 1.5).orderBy("start").collect()]
    assert got == [(0.0, 1.0, False), (1.0, 2.0, False), (2.0, 3.0, True), (3.0, 4.0, False)]
    queries = spark.createDataFrame([(1, 1.0, 2.0), (1, 8.0, 9.0)], "clip_id bigint, start double, end double")
    boxes = spark.createDataFrame([(1, 0, 0.5, 1.5), (1, 1, 0.0, 3.0), (1, 2, 1.0, 2.0)], "clip_id bigint, ord int, c_start double, c_end double")
    assert {(r.start, r.ord) for r in B.first_containing(queries, boxes, ["clip_id"], 0.7).collect()} == {(1.0, 1), (8.0, None)}


def test_orders_do_not_depend_on_buckets(spark):
    rows = spark.range(200).select((F.col("id") % 3).alias("k"), ((F.col("id") * 37) % 101).cast("double").alias("x"), "id")
    for width in (1000.0, 7.0):
        ranked = ordered.rank_along(rows, ["k"], ["x", "id"], width)
        summed = ordered.running_sum(ranked, ["k"], ["x", "id"], width, F.lit(1), "n")
        assert summed.filter("rank != n").count() == 0
        assert ranked.groupBy("k").agg(F.count_distinct("rank").alias("a"), F.max("rank").alias("b")).filter("a != b").count() == 0
    follow = ordered.next_value(rows.select("k", "x").distinct(), ["k"], "x", 5.0).filter("next <= x").count()
    assert follow == 0


def test_top_p_keeps_the_token_past_the_bound(spark):
    rows = spark.createDataFrame([(1, k, math.log(p)) for k, p in enumerate((0.5, 0.3, 0.2))], "id bigint, k int, logit double")
    for p, want in ((0.4, {0}), (0.6, {0, 1}), (0.9, {0, 1, 2})):
        assert {r.k for r in S.softmax(rows).withColumn("keep", S.top_p_keep(p)).filter("keep").collect()} == want


def test_remask(spark):
    rows = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.1), (1, 2, 0.5), (1, 3, None)], "id bigint, pos int, p double")
    line = lambda n: [r.m for r in S.remask(rows, n, 0.0).orderBy("pos").collect()]
    assert line(2) == [0, 1, 1, 0]
    assert line(0) == [0, 0, 0, 0]
    ties = spark.createDataFrame([(1, i, 0.5) for i in range(4)], "id bigint, pos int, p double")
    assert sum(r.m for r in S.remask(ties, 2, 0.0).collect()) == 0


def test_spread_ranks_remask_alike(spark):
    rows = spark.range(600).select((F.col("id") % 2).alias("id"), F.col("id").alias("pos"), F.when(F.col("id") % 7 != 0, (F.col("id") % 97 + 1) / 100.0).alias("p"))
    one, other = (S.remask(rows, 55, 2.0, spread=s).filter("m = 1").select("id", "pos") for s in (False, True))
    assert one.count() == 110 and one.exceptAll(other).count() == 0 == other.exceptAll(one).count()


def test_sampling_with_nulls_and_one_entry(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (2, 0, 1.0)], "id bigint, k int, logit double")
    assert {(r.id, r.k) for r in S.sample(rows, top_k=1).collect()} == {(1, 1), (2, 0)}
    assert S.sample(rows.filter("false")).count() == 0
    with_typical = S.sample(rows, typical_mass=0.9)
    assert with_typical.count() == 2


def test_sampler_frequencies(spark):
    rows = spark.range(4000).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).withColumn("logit", F.when(F.col("k") == 0, math.log(0.25)).otherwise(math.log(0.75)))
    share = S.inverse_cdf(S.softmax(rows)).agg(F.avg("k")).first()[0]
    assert abs(share - 0.75) < 0.03


def test_chunk_rules(spark):
    lengths = [4000, 10000, 30000, 69999, 70000, 129999, 130000, 0, -5, None]
    rows = spark.createDataFrame([(d,) for d in lengths], "d bigint").select("d", F.size(prep.chunk_starts(F.col("d"))).alias("n"))
    assert {r.d: r.n for r in rows.collect()} == {4000: 1, 10000: 1, 30000: 1, 69999: 1, 70000: 1, 129999: 1, 130000: 2, 0: 0, -5: 0, None: 0}


def test_levels(spark):
    rows = spark.createDataFrame([(-30.0,), (-30.1,), (None,), (float("nan"),), (float("-inf"),)], "loudness double")
    assert [r.ok for r in rows.select(prep.loud_enough().alias("ok")).collect()] == [True, False, False, False, False]
    x = spark.createDataFrame([([0.5, -1.0],), ([0.0, 0.0],)], "x array<double>")
    assert [r.y for r in x.select(prep.peak_normalise(F.col("x")).alias("y")).collect()] == [[0.494, -0.988], [0.0, 0.0]]
    assert [r.y for r in x.select(prep.tile_to(F.col("x"), 5).alias("y")).collect()][0] == [0.5, -1.0, 0.5, -1.0, 0.5]


def test_rounding_and_names(spark):
    rows = spark.createDataFrame([(25, "a/b.c/x-y.wav"), (35, "noext")], "n int, p string")
    got = rows.select(scalar.round_to_multiple(F.col("n"), 10).alias("r"), text.stem(F.col("p")).alias("s"), text.suffix(F.col("p")).alias("e"), text.before_last_dash(F.col("p")).alias("b"), text.zero_pad(F.col("n") * 100).alias("z")).collect()
    assert [tuple(r) for r in got] == [(20, "x-y", ".wav", "a/b.c/x", "2500"), (40, "noext", "", "noext", "3500")]


def test_group_stats(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("b", 5.0)], "c string, x double")
    got = {r.c: (r.x_mean, r.x_count, r.x_std) for r in metrics.group_stats(rows, ["c"], ["x"]).collect()}
    assert got == {"a": (2.0, 2, 1.414214), "b": (5.0, 1, None)}


def test_package_lists(spark):
    frame = lambda *x: L.package_versions(spark.createDataFrame(list(enumerate(x)), "n int, line string"))
    assert [r.requirement for r in L.changed_packages(frame("Torch 2.1", "numpy 1.23", "", "# x", "lonely"), frame("torch 2.0", "numpy 1.23")).collect()] == ["torch==2.0"]


def test_log_blocks(spark):
    log = "x[12:00:00] Iteration 10\ntrain\n  loss │ 1.5 │ 0 \nval\n  loss │ 2.5 │ 2.0 \n"
    got = {(r["index"], r.iteration, r.key): r.value for r in L.parse_logs(spark.createDataFrame([("a", log), ("b", "nothing")], "run string, text string")).collect()}
    assert got == {(1, "10", "dataset_loss"): "1.5", (1, "10", "val_loss"): "2.0"}


def test_plateau_rules():
    cfg = P.Plateau(patience=1)
    s = P.State()
    for loss in (5.0, 5.0, 5.0):
        s = P.step(cfg, s, loss, None)
    assert (s.best, s.bad, s.lr) == (5.0, 0, 5e-4)
    s = P.step(cfg, P.State(previous=0.5), 1.0, 1.2)
    assert (s.lr, s.bad, s.previous) == (5e-4, 0, 1.2)
    assert P.step(cfg, P.State(best=0.0), 3.0, None).best == 3.0
    rising = P.Plateau(factor=1.5)
    assert P.step(rising, P.State(previous=0.5), 1.0, 2.0).lr == pytest.approx(1e-3 / 1.5)
    s = P.State()
    for _ in range(10):
        s = P.exceed(rising, s, 2.0, 1.0)
    assert (s.exceeded, s.lr) == (0, pytest.approx(5e-4))
    assert P.Plateau(maximise=True).better(2.0, 1.0) and not P.Plateau(relative=False).better(0.9995, 1.0)


def test_stream_goes_on_from_its_state(spark, tmp_path):
    rows = [("a", i, float(v), None) for i, v in enumerate([5, 5, 5, 5, 5, 4, 4, 4])]
    schema = "run string, step long, loss double, grad double"
    cfg = P.Plateau(patience=2)
    source = str(tmp_path / "in")
    spark.createDataFrame(rows[:4], schema).coalesce(1).write.parquet(source)
    once = lambda: P.available(P.stream(spark.readStream.schema(schema).parquet(source), cfg), str(tmp_path / "out"), str(tmp_path / "state"))
    assert once().count() == 4
    spark.createDataFrame(rows[4:], schema).coalesce(1).write.mode("append").parquet(source)
    got = sorted(tuple(r) for r in once().collect())
    want = sorted(tuple(r) for r in P.fold(spark.createDataFrame(rows, schema), cfg).collect())
    assert got == want


def test_wav_files(spark, tmp_path):
    import wave

    from gridloom.sources.wav import WavDataSource, decode, encode

    x = np.sin(np.arange(500) / 9).astype(np.float32) * 0.9
    encode(str(tmp_path / "sub/a.wav"), x, 8000)
    rate, channels, n, back = decode(str(tmp_path / "sub/a.wav"))
    assert (rate, channels, n) == (8000, 1, 500) and np.abs(back - x).max() < 1 / 32000
    with wave.open(str(tmp_path / "b.wav"), "wb") as f:
        f.setnchannels(2), f.setsampwidth(3), f.setframerate(16000)
        f.writeframes(bytes([0, 0, 64, 0, 0, 192]))
    (tmp_path / "broken.wav").write_bytes(b"nothing")
    spark.dataSource.register(WavDataSource)
    got = {r.path.rsplit("/", 1)[-1]: r for r in spark.read.format("wav").load(str(tmp_path)).collect()}
    assert got["b.wav"].channels == 2 and got["b.wav"].samples == [0.0] and got["broken.wav"].samples is None and got["a.wav"].frames == 500
    assert spark.read.format("wav").option("recursive", "false").load(str(tmp_path)).count() == 2


def test_catalog_and_snapshots(spark, tmp_path):
    from gridloom.sources import sinks
    from gridloom.sources.grid import audio_catalog

    for name in ("rock/a.WAV", "rock/b.txt", "jazz/c.mp3"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"x")
    assert {(r.label, r.extension) for r in audio_catalog(spark, str(tmp_path / "in")).collect()} == {("rock", ".wav"), ("jazz", ".mp3")}
    write = sinks.tagged_writer(str(tmp_path / "out"), (2000,))
    for step, loss in ((1000, 2.0), (2000, 1.0), (3000, 1.5)):
        write(spark.createDataFrame([(step, loss)], "step long, loss double"), step)
    tags = {t: spark.read.parquet(str(tmp_path / "out" / t)).first().step for t in ("latest", "2k", "best")}
    assert tags == {"latest": 3000, "2k": 2000, "best": 2000}


def test_config_includes_and_scopes(tmp_path):
    (tmp_path / "base.yml").write_text("A.x: 1\nA.y: 2\ntrain/A.x: 3\n")
    (tmp_path / "top.yml").write_text("$include:\n  - base.yml\nA.y: 5\n")
    settings = config.load(tmp_path / "top.yml")
    assert settings == {"A.x": 1, "A.y": 5, "train/A.x": 3}
    assert config.scoped(settings, "train") == {"A.x": 3, "A.y": 5} and config.scoped(settings) == {"A.x": 1, "A.y": 5}
    assert set(config.fan_out("n", ["f"], "runs")) == {"coarse", "c2f", "interface"}


def test_uniforms_do_not_depend_on_partitions(spark):
    from gridloom.functions.rng import uniform

    rows = spark.range(1000)
    sums = {rows.repartition(n).agg(F.round(F.sum(uniform("s", "id")), 6)).first()[0] for n in (1, 3, 8)}
    assert len(sums) == 1 and 450 < sums.pop() < 550
