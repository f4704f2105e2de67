"""Top-k next tokens per context (E6) in bounded space: mergeable heavy-hitter
summaries, then an exact second pass with a proof that the top k is complete.

Pass 1 (``summaries``): a task keeps at most ``M`` counters per context.  When
a context has more, the (M+1)-th largest count is taken off all of them and
added to the context's error, so that a pair occurs at least ``low`` and at
most ``low + err`` times, also if it has no counter.  Summaries of tasks merge by adding
both.  A task holds ``M * 65,536`` counters at most, however much it reads.

``proofs`` decides per context, with ``tau`` the k-th largest ``low``:

* no error: the summary holds every pair, and ``low`` is the exact count;
* ``err < tau``: no pair without a counter can be among the top k, nor tie with
  them; those with ``low + err >= tau`` are the candidates, counted exactly;
* otherwise, or with more than ``2 * M`` candidates, there is no proof, and all
  pairs of the context are counted exactly.

Pass 2 counts pairs that are candidates or lie in a context without proof.  It
broadcasts a row per context (at most 65,536 of at most ``2 * M`` ids).  The
result equals ``countmodel.topk_next`` over all counts: ``(a, rnk, b, c)``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import TOKEN_LIMIT, TOP_K
from ..session import ship_package, stage_table
from .countmodel import pair_table, topk_next

M = 64                             # counters per context and task
NO_TOKEN = -1                      # row of a context's error among the rows of its pairs


class Summary:
    """Counters of one task: sorted keys ``a << 16 | b``, their counts, the error of each context."""

    def __init__(self, size: int = M):
        self.size = size
        self.key, self.count = np.empty(0, np.int64), np.empty(0, np.int64)
        self.err = np.zeros(TOKEN_LIMIT, np.int64)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Count pairs; ids must lie in ``0 .. TOKEN_LIMIT - 1``."""
        if len(a) and not (0 <= min(a.min(), b.min()) and max(a.max(), b.max()) < TOKEN_LIMIT):
            raise ValueError(f"token id outside 0 .. {TOKEN_LIMIT - 1}")
        key, count = np.unique((a.astype(np.int64) << 16) | b, return_counts=True)
        held, counts = np.concatenate([self.key, key]), np.concatenate([self.count, count])
        self.key, place = np.unique(held, return_inverse=True)
        self.count = np.zeros(len(self.key), np.int64)
        np.add.at(self.count, place, counts)
        self._cut()

    def _cut(self) -> None:
        context = self.key >> 16
        order = np.lexsort((-self.count, context))
        ordered = context[order]
        first = np.flatnonzero(np.diff(ordered, prepend=-1))
        size = np.diff(np.r_[first, len(ordered)])
        full = first[size > self.size]
        if len(full):
            off = np.zeros(TOKEN_LIMIT, np.int64)
            off[ordered[full]] = self.count[order[full + self.size]]
            self.err += off
            self.count = self.count - off[context]
            kept = self.count > 0
            self.key, self.count = self.key[kept], self.count[kept]

    def rows(self) -> pa.RecordBatch:
        """``(a, b, low, err)``: a row per counter, and one with ``NO_TOKEN`` per context with an error."""
        lossy = np.flatnonzero(self.err)
        a = np.concatenate([self.key >> 16, lossy]).astype(np.int32)
        b = np.concatenate([self.key & 0xFFFF, np.full(len(lossy), NO_TOKEN)]).astype(np.int32)
        low = np.concatenate([self.count, np.zeros(len(lossy), np.int64)])
        err = np.concatenate([np.zeros(len(self.key), np.int64), self.err[lossy]])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, low, err)], names=["a", "b", "low", "err"])


def summaries(seqs: DataFrame, size: int = M) -> DataFrame:
    """Pass 1, merged over tasks: ``(a, b, low, err)`` from sequences ``(x, y)``."""
    ship_package(seqs.sparkSession)

    def run(batches):
        held = Summary(size)
        for part in batches:
            held.add(*(part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("x", "y")))
        yield held.rows()

    parts = seqs.select("x", "y").mapInArrow(run, "a int, b int, low long, err long")
    return parts.groupBy("a", "b").agg(F.sum("low").alias("low"), F.sum("err").alias("err"))


def proofs(merged: DataFrame, k: int = TOP_K, size: int = M) -> DataFrame:
    """Per context ``(a, state, candidates)``: state ``exact``, ``proven`` with
    its candidate ids, or ``open``.  At most 65,536 rows."""
    held = merged.where(F.col("b") != NO_TOKEN).select("a", "b", "low")
    errors = merged.where(F.col("b") == NO_TOKEN).select("a", "err")
    best = Window.partitionBy("a").orderBy(F.desc("low"), F.asc("b"))
    top = (held.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
           .groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("tau")))
    # a context may have lost every counter and then has an error only
    bound = top.join(errors, "a", "full").withColumn("err", F.coalesce("err", F.lit(0)))
    sound = bound.where((F.col("err") > 0) & (F.col("n") == k) & (F.col("err") < F.col("tau")))
    likely = held.join(sound.select("a", "err", "tau"), "a").where(F.col("low") + F.col("err") >= F.col("tau"))
    chosen = (likely.groupBy("a").agg(F.collect_list("b").alias("candidates"))
              .where(F.size("candidates") <= 2 * size))
    state = (F.when(F.col("err") == 0, "exact").when(F.col("candidates").isNotNull(), "proven").otherwise("open"))
    return bound.join(chosen, "a", "left").select("a", state.alias("state"), "candidates")


def topk_bounded(seqs: DataFrame, k: int = TOP_K, size: int = M) -> DataFrame:
    """E6 from sequences ``(x, y)``: ``(a, rnk, b, c)`` as ``topk_next`` gives
    it over the counts of all pairs.  An empty table gives an empty result."""
    if not 0 < k <= size:
        raise ValueError("k must be in 1 .. size")
    merged = stage_table(summaries(seqs, size), "heavy-hitters")
    known = stage_table(proofs(merged, k, size), "heavy-proofs")
    wanted = F.broadcast(known.where(F.col("state") != "exact"))          # <= 65,536 contexts, <= 2 * size ids each
    again = (pair_table(seqs).join(wanted, "a")
             .where((F.col("state") == "open") | F.array_contains("candidates", F.col("b")))
             .groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")))
    exact = (merged.where(F.col("b") != NO_TOKEN).join(known.where(F.col("state") == "exact").select("a"), "a", "left_semi")
             .select("a", "b", F.col("low").alias("c")))
    return topk_next(exact.unionByName(again), k)
