"""Rank-strided batch dealing (E4), cyclic epochs (E8), the step schedule
(C3), accumulation steps (B11) and short-shard reporting (Q9).

The reference keeps a mutable cursor per rank.  Here the cursor is a closed
form of the manifest: in a shard of length L, rank r takes the batches
``b = r + k*W`` (start ``b*B*T``) for ``k < K_r`` where

    K_r = max(1, (L - N - B*T*r) div (B*T*W))   if the first batch fits
    K_r = 0                                      otherwise (reported, Q9)

then moves to the next shard, wrapping to the first after the last.  Micro
step ``m`` of a rank therefore maps to epoch ``m div M_r`` and a position in
the cumulative K_r sequence.  The schedule is generated from the shard side
(no range join): each (rank, shard, epoch) explodes only the batches that a
requested step actually uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import WindowSpec, accumulation_steps
from ..functions.schedules import curriculum_stage


def _per_rank(manifest: DataFrame, spec: WindowSpec, aligned: bool = False) -> DataFrame:
    BT, W, N = spec.B * spec.T, spec.W, spec.N
    df = manifest.select("shard_id", F.col("n_tokens").cast("long").alias("L"))
    df = df.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(W - 1))))
    fits = F.lit(BT) * F.col("rank") + F.lit(BT + N) <= F.col("L")
    k = F.greatest(F.lit(1).cast("long"),
                   F.expr(f"(L - {N} - {BT} * `rank`) div {BT * W}"))
    df = df.withColumn("K", F.when(fits, k).otherwise(F.lit(0).cast("long")))
    if aligned:
        # Q8 option: all ranks leave a shard together (W rows per window group)
        df = df.withColumn("K", F.min("K").over(Window.partitionBy("shard_id")))
    return df


def rank_batches(manifest: DataFrame, spec: WindowSpec, aligned: bool = False) -> DataFrame:
    """``(shard_id, rank, k, batch, pos)`` for one split's manifest.
    ``aligned=True`` gives every rank the smallest count of the shard (Q8)."""
    BT, W = spec.B * spec.T, spec.W
    df = _per_rank(manifest, spec, aligned).where(F.col("K") > 0)
    df = df.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("K") - 1)))
    batch = F.col("rank") + F.col("k") * F.lit(W)
    return df.select("shard_id", "rank", "k", batch.alias("batch"),
                     (batch * F.lit(BT)).alias("pos"))


def batches_per_rank(manifest: DataFrame, spec: WindowSpec) -> DataFrame:
    """``(shard_id, rank, K)`` including ranks whose first batch does not fit."""
    return _per_rank(manifest, spec).select("shard_id", "rank", "K")


def short_shards(manifest: DataFrame, spec: WindowSpec) -> DataFrame:
    """Q9: shards (per rank) too short for that rank's first batch."""
    return batches_per_rank(manifest, spec).where(F.col("K") == 0)


def batch_schedule(manifest: DataFrame, spec: WindowSpec, accum_steps: int,
                   max_steps: int, start_step: int = 0, aligned: bool = False) -> DataFrame:
    """C3 + E8 + B12: which batch each rank reads at each micro step of steps
    ``[start_step, max_steps)``:
    ``(step, micro_step, rank, epoch, shard_id, k, batch, pos, stage)``.

    The loader position is a function of the step, so a resumed run (Q12)
    continues exactly where it stopped instead of restarting at shard 0."""
    A, W, BT = int(accum_steps), spec.W, spec.B * spec.T
    if A <= 0 or max_steps <= 0:
        raise ValueError("accum_steps and max_steps must be positive")
    m_lo, m_hi = start_step * A, max_steps * A
    per = _per_rank(manifest, spec, aligned)
    w_cum = (Window.partitionBy("rank").orderBy("shard_id")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    w_all = Window.partitionBy("rank")
    per = (per.withColumn("cum", F.sum("K").over(w_cum) - F.col("K"))
           .withColumn("M", F.sum("K").over(w_all)))
    per = per.withColumn("M", F.when(F.col("M") > 0, F.col("M")).otherwise(
        F.raise_error(F.lit("no shard of this split fits one batch for a rank"))))
    per = per.where(F.col("K") > 0)
    e_lo = F.expr(f"{m_lo} div M")
    e_hi = F.expr(f"({m_hi} - 1) div M")
    per = per.withColumn("epoch", F.explode(F.sequence(e_lo, e_hi)))
    per = per.withColumn("m0", F.col("epoch") * F.col("M") + F.col("cum"))
    k_lo = F.greatest(F.lit(0).cast("long"), F.lit(m_lo) - F.col("m0"))
    k_hi = F.least(F.col("K") - 1, F.lit(m_hi - 1) - F.col("m0"))
    per = per.where(k_hi >= k_lo).withColumn("k", F.explode(F.sequence(k_lo, k_hi)))
    m = F.col("m0") + F.col("k")
    batch = F.col("rank") + F.col("k") * F.lit(W)
    out = per.select(
        F.expr(f"(m0 + k) div {A}").alias("step"),
        (m % F.lit(A)).alias("micro_step"), "rank", "epoch", "shard_id", "k",
        batch.alias("batch"), (batch * F.lit(BT)).alias("pos"))
    return out.withColumn("stage", curriculum_stage(F.col("step"), max_steps))


def schedule_sequences(schedule: DataFrame, spec: WindowSpec) -> DataFrame:
    """C3 at sequence level: each scheduled batch expands to its B rows,
    ``seq = batch*B + row`` — the key to join with ``sequences``."""
    return (schedule.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(spec.B - 1))))
            .withColumn("seq", F.col("batch") * F.lit(spec.B) + F.col("row")))


def scheduled_fragments(fragments: DataFrame, schedule: DataFrame, spec: WindowSpec) -> DataFrame:
    """Fragments overlapping the token ranges a schedule reads: per shard
    ``[min pos, max pos + B*T + N)`` (one row per shard), so windowing and the
    join to the schedule work on what the steps read, not the whole split."""
    reach = spec.B * spec.T + spec.N
    ranges = schedule.groupBy("shard_id").agg(F.min("pos").alias("_lo"),
                                              (F.max("pos") + F.lit(reach)).alias("_hi"))
    f = fragments.join(ranges, "shard_id")
    return (f.where((F.col("pos") + F.size("tokens") > F.col("_lo")) & (F.col("pos") < F.col("_hi")))
            .drop("_lo", "_hi"))


def accumulation_report(manifest: DataFrame, spec: WindowSpec, total_batch_tokens: int) -> DataFrame:
    """B11, report form: ``(B, W, divides, accum_steps, steps_per_round)``:
    micro steps of an optimiser step (null where its tokens do not divide), and
    the whole steps that the rank with the fewest batches gets from one round."""
    try:
        steps = accumulation_steps(total_batch_tokens, spec)
    except ValueError:
        steps = None
    rounds = batches_per_rank(manifest, spec).groupBy("rank").agg(F.sum("K").alias("M")).agg(F.min("M").alias("m"))
    count = F.lit(steps).cast("long")
    return rounds.select(F.lit(spec.B).alias("B"), F.lit(spec.W).alias("W"), F.lit(steps is not None).alias("divides"),
                         count.alias("accum_steps"), F.expr(f"m div {steps}" if steps else "cast(null as bigint)").alias("steps_per_round"))
