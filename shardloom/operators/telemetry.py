"""Run telemetry analytics: step loss (D3, D4), loss history (A9, D5, G2,
G6), resume (B14, D6), checkpoint steps (B13), step duration (E5), throughput
(D8), test loss (D7), run comparison (D11), learning rate (H9), curriculum
stage (B12) and the state-key prefix test (H8).

All of it is grouped by ``(run, step)`` or ``run``; groups have at most
``W*A`` records (a step) or one row per step (a run), and every aggregate is
partial + final, so a large run never sits in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TelemetrySpec
from ..functions.schedules import curriculum_stage, is_checkpoint_step, learning_rate
from ..sources.telemetry import format_step_line


def step_loss(tel: DataFrame, spec: TelemetrySpec = TelemetrySpec()) -> DataFrame:
    """D3 + D4: per rank the sum of ``loss / A`` over micro steps, then the
    mean over ranks (equal weight per rank, as an all-reduce average)."""
    per_rank = (tel.groupBy("run", "step", "rank")
                .agg(F.sum(F.col("loss") / F.lit(float(spec.A))).alias("loss")))
    return per_rank.groupBy("run", "step").agg(F.avg("loss").alias("loss"))


def step_duration(tel: DataFrame) -> DataFrame:
    """E5: wall time of a step, first to last record, in milliseconds."""
    d = tel.groupBy("run", "step").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    dt = F.expr("timestampdiff(MICROSECOND, t0, t1)")
    return d.select("run", "step", "t0", (dt / F.lit(1000.0)).alias("dt_ms"))


def run_lengths(tel: DataFrame) -> DataFrame:
    """``max_steps`` of each run: its number of complete steps."""
    return tel.groupBy("run").agg((F.max("step") + F.lit(1)).alias("max_steps"))


def throughput(durations: DataFrame, spec: TelemetrySpec = TelemetrySpec(), keep=()) -> DataFrame:
    """``B*T*A*W / dt`` tokens per second (null for a zero duration);
    ``keep`` names further columns of ``durations``."""
    tokens = float(spec.B * spec.T * spec.A * spec.W)
    dt_s = F.col("dt_ms") / F.lit(1000.0)
    return durations.select("run", "step", "dt_ms", *keep,
                            F.when(dt_s > 0, F.lit(tokens) / dt_s).alias("tok_per_sec"))


def step_table(tel: DataFrame, spec: TelemetrySpec = TelemetrySpec()) -> DataFrame:
    """One row per (run, step): loss, lr, stage, start, duration, throughput.

    Loss, first and last time of a step come out of one pair of aggregates;
    only a run's number of steps needs another look at the records."""
    per_rank = (tel.groupBy("run", "step", "rank")
                .agg(F.sum(F.col("loss") / F.lit(float(spec.A))).alias("loss"),
                     F.min("ts").alias("t0"), F.max("ts").alias("t1")))
    per_step = per_rank.groupBy("run", "step").agg(F.avg("loss").alias("loss"), F.min("t0").alias("t0"),
                                                   F.max("t1").alias("t1"))
    dt_ms = F.expr("timestampdiff(MICROSECOND, t0, t1)") / F.lit(1000.0)
    dur = throughput(per_step.withColumn("dt_ms", dt_ms), spec, keep=("t0", "loss"))
    out = dur.join(run_lengths(tel), "run")
    return out.select(
        "run", "step", "loss", "t0", "dt_ms", "tok_per_sec", "max_steps",
        learning_rate(F.col("step"), spec.warmup_steps, F.col("max_steps"),
                      spec.max_lr, spec.min_lr).alias("lr"),
        curriculum_stage(F.col("step"), F.col("max_steps")).alias("stage"))


def loss_curve(steps: DataFrame) -> DataFrame:
    """A9 + G2 + G6: curves of all runs in step order, with ``log10(loss)`` for
    the log axis."""
    return (steps.select("run", "step", "loss", F.log10("loss").alias("log10_loss"))
            .orderBy("run", "step"))


def curve_pixels(steps: DataFrame, width: int) -> DataFrame:
    """G2 for plotting: the points ``(run, px, step, loss)`` that draw the same
    picture, ``width`` pixel columns wide, as all points of all runs on shared
    axes (step, log of loss): the first, last, least and greatest of each run
    in each column, a point that is several of them once.  At most ``4 *
    width`` rows a run, from one partial + final aggregate.

    A point that a log axis can't show (null, NaN, infinite, or not above 0) is
    left out.  Of equal losses the earlier step counts, of records of one step
    the smaller loss as first and the greater as last; a single step falls into
    column 0."""
    if width <= 0:
        raise ValueError("width must be positive")
    shown = steps.where((F.col("loss") > 0) & (F.col("loss") < float("inf")) & F.col("step").isNotNull()).select("run", F.col("step").cast("long").alias("step"), "loss")
    lo, hi = shown.agg(F.min("step"), F.max("step")).first()              # the shared axis, one row
    lo, span = (0, 1) if lo is None else (lo, hi - lo + 1)
    px = F.expr(f"(step - {lo}) * {int(width)} div {span}")
    by_step, by_loss = F.struct("step", "loss"), F.struct("loss", F.negative("step").alias("back"))
    ends = shown.groupBy("run", px.alias("px")).agg(
        F.min(by_step).alias("first"), F.max(by_step).alias("last"),
        F.min(F.struct("loss", "step")).alias("least"), F.max(by_loss).alias("greatest"))
    of_step = lambda c, step: F.struct(step.alias("step"), F.col(f"{c}.loss").alias("loss"))
    points = F.array_distinct(F.array(of_step("first", F.col("first.step")), of_step("least", F.col("least.step")),
                                      of_step("greatest", -F.col("greatest.back")), of_step("last", F.col("last.step"))))
    return ends.select("run", "px", F.explode(points).alias("p")).select("run", "px", "p.step", "p.loss")


def loss_map(steps: DataFrame, block: int = 1000) -> DataFrame:
    """The history as ``map<step, loss>``, one per run and block of
    ``block`` steps, so that no group grows with the run: ``(run, block,
    loss_per_step)``, entries in step order."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("step").cast("long"), "loss")))
    blocks = steps.groupBy("run", F.expr(f"step div {int(block)}").alias("block"))
    return blocks.agg(F.map_from_entries(entries).alias("loss_per_step"))


def resume_point(steps: DataFrame) -> DataFrame:
    """D6 + B14: last finished step and the step a resumed run starts at."""
    return steps.groupBy("run").agg(F.max("step").alias("last_step"),
                                    F.count(F.lit(1)).alias("n_steps")) \
        .withColumn("resume_step", F.col("last_step") + F.lit(1))


def resume_merge(history: DataFrame, fresh: DataFrame, resume: bool) -> DataFrame:
    """With ``resume`` keep the saved history and append new steps after
    ``max(step)``; without it the history is dropped."""
    if not resume:
        return fresh
    last = history.groupBy("run").agg(F.max("step").alias("_last"))
    new = fresh.join(last, "run", "left").where(
        F.col("_last").isNull() | (F.col("step") > F.col("_last"))).drop("_last")
    return history.unionByName(new)


def checkpoint_steps(steps: DataFrame) -> DataFrame:
    """Steps at which state is saved (every ``max_steps // 20`` + last)."""
    return steps.where(is_checkpoint_step(F.col("step"), F.col("max_steps"))) \
        .select("run", "step", "loss")


def test_loss(batch_losses: DataFrame, max_steps: int) -> DataFrame:
    """D7 (+ D4): per rank ``sum(loss) / max_steps`` over the batches that
    ``max_steps`` loader calls read — a batch that the loader comes back to
    counts each time (``n_reads``) — then the mean over ranks."""
    per = batch_losses.groupBy("run", "rank").agg((F.sum(F.col("loss") * F.col("n_reads")) / F.lit(float(max_steps))).alias("loss"))
    return per.groupBy("run").agg(F.avg("loss").alias("test_loss"))


def run_summary(steps: DataFrame, test: DataFrame | None = None) -> DataFrame:
    """The comparison table: final loss, best loss, mean time per step,
    mean throughput, and the mean test loss of runs that ``test`` has."""
    table = steps.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_steps"),
        F.max_by("loss", "step").alias("final_loss"),
        F.min("loss").alias("min_loss"),
        F.avg("dt_ms").alias("mean_dt_ms"),
        F.avg("tok_per_sec").alias("mean_tok_per_sec"))
    return table if test is None else table.join(test.select("run", "test_loss"), "run", "full")


def step_log_lines(steps: DataFrame) -> DataFrame:
    """H12 over the step table: the line the trainer logs per step."""
    norm = F.col("norm") if "norm" in steps.columns else F.lit(None).cast("double")
    return steps.select("run", "step", format_step_line(
        F.col("step"), F.col("loss"), F.col("lr"), norm, F.col("dt_ms"),
        F.col("tok_per_sec")).alias("line"))


def stage_maps(steps: DataFrame) -> DataFrame:
    """Per run, a map ``stage_<n> -> steps`` (the staged model's state keys)."""
    per = steps.groupBy("run", "stage").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat(F.lit("stage_"), F.col("stage").cast("string")), "n"))).alias("state_keys"))


def map_has_prefix(m, prefix: str):
    """H8: does any key of the map start with ``prefix``?"""
    return F.exists(F.map_keys(m), lambda k: k.startswith(prefix))
