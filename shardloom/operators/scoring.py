"""Batch scoring with a supplied model (J2) and per-batch test loss.

``score_sequences`` hands each Arrow batch of sequences to a user function
``fn(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray`` (one loss per
sequence) in ``mapInPandas``; Spark partitions the sequences, the function
only sees its batch.  With ``progress_col`` the function also gets how far
training is when each sequence is read, ``(step + 1) / max_steps``, as a staged
model needs it: ``fn(x, y, progress: np.ndarray)``.  ``unigram_scorer`` is a supplied model whose whole
state is one log-probability per token id (at most 65,536 values, broadcast).

``test_batch_losses`` is the count model's score of every test batch the
loader would deal, as joins: pairs of the batch's sequences against the pair
counts, mean ``-ln p`` per (rank, batch).  ``test_rank_losses`` gives the sums
per rank alone.
"""

from __future__ import annotations

from typing import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TOKEN_LIMIT, WindowSpec
from ..session import ship_package
from .batches import batch_schedule
from .countmodel import _check_vocab, context_totals, pair_counts, unfolded


def score_sequences(seqs: DataFrame, fn: Callable, keys: Sequence[str] = ("split", "shard_id", "seq"),
                    out_col: str = "loss", progress_col: str | None = None) -> DataFrame:
    """``(keys..., loss)`` per sequence from a supplied scoring function."""
    spark = seqs.sparkSession
    ship_package(spark)
    keys = [k for k in keys if k in seqs.columns]
    more = [F.col(progress_col).cast("double").alias("_progress")] if progress_col else []
    in_df = seqs.select(*keys, "x", "y", *more)
    fields = [f for f in in_df.schema.fields if f.name in keys] + [T.StructField(out_col, T.DoubleType())]

    def run(batches):
        for pdf in batches:
            given = [pdf["_progress"].to_numpy(np.float64)] if progress_col else []
            losses = fn(list(pdf["x"]), list(pdf["y"]), *given) if len(pdf) else np.empty(0)
            out = pdf[keys].copy()
            out[out_col] = np.asarray(losses, dtype=np.float64)
            yield out

    return in_df.mapInPandas(run, T.StructType(fields))


def unigram_log_probs(counts: DataFrame, vocab_size: int) -> np.ndarray:
    """Add-one smoothed ``ln p(b)`` from ``(b, c)`` counts: a dense array of
    ``vocab_size`` values (bounded by 65,536)."""
    if not 0 < vocab_size <= TOKEN_LIMIT:
        raise ValueError("vocab_size must be in (0, 65536]")
    rows = counts.groupBy("b").agg(F.sum("c").alias("c")).collect()     # <= vocab_size rows
    c = np.zeros(vocab_size, dtype=np.float64)
    for r in rows:
        c[int(r.b)] = float(r.c)
    return np.log((c + 1.0) / (c.sum() + vocab_size))


def unigram_scorer(log_probs: np.ndarray) -> Callable:
    """A supplied model: mean ``-ln p(y)`` per sequence (inputs ignored)."""
    lp = np.asarray(log_probs, dtype=np.float64)

    def fn(xs, ys):
        lengths = np.fromiter(map(len, ys), np.int64, len(ys))
        if not lengths.all():
            raise ValueError("a sequence without targets has no loss")
        flat = lp[np.concatenate(ys).astype(np.int64)]
        return -np.add.reduceat(flat, np.cumsum(lengths) - lengths) / lengths
    return fn


def staged_scorer(log_probs: np.ndarray, stages: int = 3) -> Callable:
    """A supplied model whose reach grows with training: in stage s of
    ``stages`` (equal parts of the progress, the end in the last) it is asked
    for the first s/``stages`` of a sequence's targets; mean ``-ln p(y)``."""
    lp = np.asarray(log_probs, dtype=np.float64)

    def fn(xs, ys, progress):
        stage = np.minimum(np.floor(progress * stages).astype(np.int64) + 1, stages)
        sizes = [max(1, len(y) * int(s) // stages) for y, s in zip(ys, stage)]
        return np.array([-lp[np.asarray(y[:n], np.int64)].mean() for y, n in zip(ys, sizes)])
    return fn


def _dealt_sequences(test_seqs: DataFrame, test_manifest: DataFrame, spec: WindowSpec, max_steps: int) -> DataFrame:
    """The sequences of the batches that ``max_steps`` loader calls read, with
    their ``rank``, ``batch`` and ``n_reads``."""
    schedule = batch_schedule(test_manifest, spec, 1, max_steps)
    dealt = schedule.groupBy("rank", "shard_id", "batch").agg(F.count(F.lit(1)).alias("n_reads"))
    return test_seqs.withColumn("batch", F.expr(f"seq div {spec.B}")).join(dealt, ["shard_id", "batch"])


def _with_nll(pairs: DataFrame, counts: DataFrame, vocab_size: int):
    """``pairs`` joined to the counts of ``(a, b)``, and ``-ln p(b|a)`` of a row, add-one smoothing."""
    joined = pairs.join(counts, ["a", "b"], "left").join(context_totals(counts), "a", "left")
    return joined, -F.log((F.coalesce("c", F.lit(0)) + F.lit(1.0)) / (F.coalesce("ca", F.lit(0)) + F.lit(float(vocab_size))))


def test_rank_losses(test_seqs: DataFrame, test_manifest: DataFrame, counts: DataFrame,
                     spec: WindowSpec, vocab_size: int, max_steps: int, run: str = "count-model") -> DataFrame:
    """D7 without a row per batch: ``(run, rank, loss)``, the sum of batch
    losses over ``max_steps``.  All batches have ``B*T`` targets, so a rank's
    loss is a sum over its distinct pairs, weighted by how often each is read;
    pairs are counted within tasks before anything is shuffled, hot ones too."""
    _check_vocab(vocab_size)
    dealt = _dealt_sequences(test_seqs, test_manifest, spec, max_steps)
    per = pair_counts(dealt, "rank", "n_reads").select("rank", "a", "b", (F.col("n_reads") * F.col("c")).alias("n"))
    j, nll = _with_nll(per, counts, vocab_size)
    total = F.sum(F.col("n") * nll) / F.lit(float(spec.B * spec.T * max_steps))
    return j.groupBy("rank").agg(total.alias("loss")).select(F.lit(run).alias("run"), "rank", "loss")


def test_batch_losses(test_seqs: DataFrame, test_manifest: DataFrame, counts: DataFrame,
                      spec: WindowSpec, vocab_size: int, max_steps: int, run: str = "count-model") -> DataFrame:
    """Per test batch that ``max_steps`` loader calls of each rank read (going
    round when the split ends) ``(run, rank, shard_id, batch, n_reads, loss)``,
    loss = mean ``-ln p(b|a)`` over its ``B*T`` targets (add-one smoothing).

    Sequences join the batches before their tokens are unfolded."""
    _check_vocab(vocab_size)
    dealt = unfolded(_dealt_sequences(test_seqs, test_manifest, spec, max_steps), "rank", "n_reads", "shard_id", "batch")
    per = (dealt.groupBy("rank", "shard_id", "batch", "a", "b")
           .agg(F.count(F.lit(1)).alias("n"), F.first("n_reads").alias("n_reads")))
    j, nll = _with_nll(per, counts, vocab_size)
    return (j.groupBy("rank", "shard_id", "batch")
            .agg(F.first("n_reads").alias("n_reads"), (F.sum(F.col("n") * nll) / F.sum("n")).alias("loss"))
            .withColumn("run", F.lit(run)))
