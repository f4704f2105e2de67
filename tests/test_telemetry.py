"""Telemetry operators against in-test Python expectations."""

import math
import random

from pyspark.sql import functions as F

from shardloom.config import TelemetrySpec
from shardloom.functions.schedules import checkpoint_stride, curriculum_stage, is_checkpoint_step, learning_rate
from shardloom.operators import telemetry as TM
from shardloom.sources.telemetry import format_step_line, parse_step_lines, step_line_report, telemetry_from_events

from conftest import SF_SMALL


def ref_lr(it, warmup, max_steps, hi=6e-4, lo=6e-5):
    if it < warmup:
        return hi * (it + 1) / warmup
    if it > max_steps:
        return lo
    ratio = (it - warmup) / (max_steps - warmup)
    return lo + 0.5 * (1.0 + math.cos(math.pi * ratio)) * (hi - lo)


def test_lr_stage_checkpoint_functions(spark):
    df = spark.range(0, 60).withColumnRenamed("id", "step")
    rows = df.select("step", learning_rate(F.col("step"), 7, 50, 6e-4, 6e-5).alias("lr"),
                     curriculum_stage(F.col("step"), 50).alias("stage"),
                     is_checkpoint_step(F.col("step"), 50).alias("ck"),
                     is_checkpoint_step(F.col("step"), 7).alias("ck7")).collect()
    for r in rows:
        assert math.isclose(r.lr, ref_lr(r.step, 7, 50), rel_tol=1e-12)
        p = (r.step + 1) / 50
        assert r.stage == (1 if p < 1 / 3 else 2 if p < 2 / 3 else 3)
        assert r.ck == (r.step < 50 and (r.step % 2 == 0 or r.step == 49))
        assert r.ck7 == (r.step < 7)              # stride floored at 1 (Q14)
    assert spark.range(1).select(checkpoint_stride(F.lit(5)).alias("s")).collect()[0].s == 1


def test_telemetry_derivation_and_step_loss(spark):
    rng = random.Random(3)
    events = spark.createDataFrame(
        [(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", rng.choice(["r1", "r2"]), float(rng.randint(1, 99)))
         for i in range(200)], "event_id long, ts string, event_type string, value double"
    ).withColumn("ts", F.to_timestamp("ts"))
    spec = TelemetrySpec(A=2, W=3)
    tel = telemetry_from_events(events, spec).collect()
    by_run = {}
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.event_id)):
        by_run.setdefault(r.event_type, []).append(r.value)
    want = {}
    for run, vals in by_run.items():
        full = len(vals) // 6 * 6
        for i, v in enumerate(vals[:full]):
            want[(run, i // 6, (i // 3) % 2, i % 3)] = v
    assert {(r.run, r.step, r.micro_step, r.rank): r.loss for r in tel} == want
    sl = {(r.run, r.step): r.loss for r in TM.step_loss(telemetry_from_events(events, spec), spec).collect()}
    for (run, step), loss in sl.items():
        ranks = [sum(want[(run, step, m, k)] / 2 for m in range(2)) for k in range(3)]
        assert math.isclose(loss, sum(ranks) / 3)


def test_loss_map_resume_and_parse(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    spec = TelemetrySpec()
    sl = TM.step_loss(telemetry_from_events(ev, spec), spec)
    maps = {}
    for r in TM.loss_map(sl, block=10).collect():
        assert {s // 10 for s in r.loss_per_step} == {r.block}
        maps.setdefault(r.run, {}).update(r.loss_per_step)
    flat = {}
    for r in sl.collect():
        flat.setdefault(r.run, {})[r.step] = r.loss
    assert maps == flat
    rp = {r.run: (r.last_step, r.resume_step) for r in TM.resume_point(sl).collect()}
    assert all(rs == ls + 1 == max(flat[k]) + 1 for k, (ls, rs) in rp.items())
    hist = sl.where(F.col("step") < 5)
    merged = TM.resume_merge(hist, sl.withColumn("loss", F.lit(-1.0)), resume=True)
    m = {(r.run, r.step): r.loss for r in merged.collect()}
    assert all((v >= 0) == (k[1] < 5) for k, v in m.items())
    assert TM.resume_merge(hist, sl, resume=False).count() == sl.count()
    steps = TM.step_table(telemetry_from_events(ev, spec), spec)
    lines = TM.step_log_lines(steps).select("run", F.col("line").alias("value"))
    parsed = {(r.run, r.step): r for r in parse_step_lines(lines).collect()}
    for r in steps.collect():
        p = parsed[(r.run, r.step)]
        assert math.isclose(p.loss, round(r.loss, 6), abs_tol=1e-6)
        assert math.isclose(p.lr, float(f"{r.lr:.4e}"))


def test_resume_without_history(spark):
    empty = spark.createDataFrame([], "run string, step long, loss double")
    fresh = spark.createDataFrame([("r", 0, 1.0), ("r", 1, 0.5)], "run string, step long, loss double")
    assert sorted(map(tuple, TM.resume_merge(empty, fresh, True).collect())) == [("r", 0, 1.0), ("r", 1, 0.5)]
    assert TM.resume_point(empty).count() == 0


def test_numbers_print_as_c_does(spark):
    rng = random.Random(1)
    vals = [2.675, 0.125, 0.375, 1.005, -0.0, -1.115, 1e-7, 1e15] + [rng.randrange(10 ** 7) / 1000 for _ in range(3000)] \
        + [rng.random() * 10 ** rng.randint(-8, 8) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    line = format_step_line(F.lit(7), F.col("x"), F.col("x"), F.col("x"), F.col("x"), F.col("x"))
    for r in df.select("x", line.alias("line")).collect():
        assert r.line == f"step {7:5d} | loss: {r.x:.6f} | lr {r.x:.4e} | norm: {r.x:.4f} | dt: {r.x:.2f}ms | tok/sec: {r.x:.2f}"


def test_diverged_steps_come_back_and_bad_lines_are_counted(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("r", 0, nan, inf), ("r", 1, -inf, None), ("r", 2, 1.5, 2.0)]
    df = spark.createDataFrame(rows, "run string, step long, loss double, rate double")
    lines = df.select("run", format_step_line(F.col("step"), F.col("loss"), F.lit(1e-4), F.lit(None).cast("double"), F.lit(0.0),
                                              F.col("rate")).alias("value"))
    lines = lines.union(spark.createDataFrame([("r", "step x | loss"), ("r", "saved")], "run string, value string"))
    got = {r.step: r for r in parse_step_lines(lines).collect()}
    assert math.isnan(got[0].loss) and got[0].tok_per_sec == inf and got[1].loss == -inf and math.isnan(got[1].tok_per_sec)
    assert got[2].loss == 1.5
    [report] = step_line_report(lines).collect()
    assert (report.n_lines, report.n_steps, report.n_unread) == (5, 3, 1)


def test_test_loss_counts_batches_read_again(spark):
    df = spark.createDataFrame([("m", 0, 1.0, 2), ("m", 0, 4.0, 1), ("m", 1, 2.0, 3)], "run string, rank int, loss double, n_reads long")
    [row] = TM.test_loss(df, 3).collect()
    assert math.isclose(row.test_loss, ((2 * 1.0 + 4.0) / 3 + 2.0) / 2)
