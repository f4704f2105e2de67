"""Tumbling count windows (E3), shifted-target pairs (C1), tail drop (B10) and
the (B, T) reshape (H6).

Sequence ``seq`` of a shard covers positions ``[seq*T, seq*T + T + N)``:
``x = w[0:T]``, ``y = w[N:N+T]``.  Windows never cross a shard and only full
ones are emitted.  Windows inside one fragment are sliced where they are; a
window crossing fragments is gathered by ``(shard_id, seq)``, a group of at
most ``T + N`` tokens, so no group can grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import WindowSpec


def sequences(fragments: DataFrame, T: int, N: int, keep_cols=("split",)) -> DataFrame:
    """E3 + B10: ``(..., shard_id, seq, x, y)`` from ``(shard_id, pos, tokens)``
    fragments (any extra ``keep_cols`` present are carried as group keys).

    A window lying entirely inside one fragment is sliced in place, with no
    shuffle; only windows that straddle fragment boundaries (at most two per
    fragment) are cut into pieces and gathered by ``(shard_id, seq)``.  With
    documents longer than a window, almost no token crosses the network."""
    if T <= 0 or N <= 0:
        raise ValueError("T and N must be positive")
    extra = [c for c in keep_cols if c in fragments.columns]
    f = fragments.select(*extra, "shard_id", "pos", "tokens",
                         F.size("tokens").cast("long").alias("_m"))
    # whole windows: seq*T >= pos and seq*T + T + N <= pos + m
    w_lo = F.expr(f"(pos + {T - 1}) div {T}")
    w_hi = F.expr(f"(pos + _m - {T + N}) div {T}")
    inner = f.where(F.col("pos") + F.col("_m") >= F.lit(T + N))
    inner = (inner.withColumn("_wlo", w_lo).withColumn("_whi", w_hi)
             .where(F.col("_whi") >= F.col("_wlo"))
             .withColumn("seq", F.explode(F.sequence("_wlo", "_whi"))))
    off = (F.col("seq") * F.lit(T) - F.col("pos") + F.lit(1)).cast("int")
    whole = inner.select(*extra, "shard_id", "seq", F.slice("tokens", off, T).alias("x"),
                         F.slice("tokens", off + F.lit(N), T).alias("y"))
    # straddling windows: touched but not whole.  Only the two runs at the
    # fragment's ends are generated (at most 1 + ceil(N/T) windows each), never
    # the whole windows in between.
    lo = F.greatest(F.lit(0).cast("long"), F.expr(f"(pos - {N}) div {T}"))
    hi = F.expr(f"(pos + _m - 1) div {T}")
    empty = F.array().cast("array<bigint>")

    def run(a, b):
        return F.when(a <= b, F.sequence(a, b)).otherwise(empty)

    has_whole = (F.col("pos") + F.col("_m") >= F.lit(T + N)) & (w_hi >= w_lo)
    ends = F.when(has_whole, F.concat(run(lo, F.least(hi, w_lo - 1)), run(F.greatest(lo, w_hi + 1), hi))) \
        .otherwise(run(lo, hi))
    g = f.withColumn("seq", F.explode(ends))
    start = F.col("seq") * F.lit(T)
    cut_lo = F.greatest(F.col("pos"), start)
    cut_hi = F.least(F.col("pos") + F.col("_m"), start + F.lit(T + N))
    g = (g.withColumn("_lo", cut_lo).withColumn("_hi", cut_hi)
         .where(F.col("_hi") > F.col("_lo")))
    piece = F.slice("tokens", (F.col("_lo") - F.col("pos") + 1).cast("int"),
                    (F.col("_hi") - F.col("_lo")).cast("int"))
    parts = (g.groupBy(*extra, "shard_id", "seq")
             .agg(F.array_sort(F.collect_list(F.struct(F.col("_lo").alias("p"),
                                                       piece.alias("t")))).alias("_parts")))
    w = F.flatten(F.transform("_parts", lambda s: s["t"]))
    joined = parts.select(*extra, "shard_id", "seq", w.alias("_w")).where(F.size("_w") == T + N)
    crossing = joined.select(*extra, "shard_id", "seq",
                             F.slice("_w", 1, T).alias("x"), F.slice("_w", N + 1, T).alias("y"))
    return whole.unionByName(crossing)


def target_pairs(seqs: DataFrame, T: int) -> DataFrame:
    """Position ``p`` paired with ``p + N`` inside one shard, one row per
    target: ``(..., shard_id, pos, a, b)``."""
    extra = [c for c in seqs.columns if c not in ("shard_id", "seq", "x", "y")]
    z = seqs.select(*extra, "shard_id", "seq", F.posexplode(F.arrays_zip("x", "y")).alias("j", "xy"))
    return z.select(*extra, "shard_id",
                    (F.col("seq") * F.lit(T) + F.col("j")).alias("pos"),
                    F.col("xy.x").alias("a"), F.col("xy.y").alias("b"))


def batch_rows(seqs: DataFrame, spec: WindowSpec) -> DataFrame:
    """H6: the flat run of sequences viewed as ``(B, T)`` batches:
    ``batch = seq div B``, ``row = seq mod B``."""
    return (seqs.withColumn("batch", F.expr(f"seq div {spec.B}"))
            .withColumn("row", F.expr(f"seq % {spec.B}")))
