"""C3 + E2 turned round: which documents a training step read, and how many tokens of each.

The schedule gives, for each step, micro step and rank, a shard and a range of positions ``[pos, pos + B*T + N)``; packing gives each
document's spans ``[pos, pos + length)`` in its shards.  Who overlaps whom is an interval join.  Both sides are cut into bins of ``bin_tokens``
positions and joined by equality on (shard, bin): a range covers few bins, a span as many as it has tokens over the bin's size, and a
bin's rows are bounded by its tokens on the one side and by the reads of its batches on the other.  A pair that meets in several bins is
counted in each for the part that lies in that bin, so nothing has to be made distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import WindowSpec


def _binned(rows: DataFrame, bin_tokens: int) -> DataFrame:
    """A row for each bin that ``[lo, hi)`` touches, cut to the bin."""
    rows = rows.where("hi > lo").withColumn("bin", F.explode(F.sequence(F.expr(f"lo div {bin_tokens}"), F.expr(f"(hi - 1) div {bin_tokens}"))))
    start = F.col("bin") * F.lit(bin_tokens)
    return rows.withColumns({"lo": F.greatest("lo", start), "hi": F.least("hi", start + F.lit(bin_tokens))})


def step_documents(schedule: DataFrame, spans: DataFrame, spec: WindowSpec, bin_tokens: int = 0) -> DataFrame:
    """``(step, rank, source_ord, doc_ord, n_read, n_tokens)`` from a schedule ``(step, micro_step, rank, shard_id, pos)`` and the
    documents' spans ``(source_ord, doc_ord, shard_id, pos, length)``.

    ``n_read`` counts the tokens that the step's batches of the rank held of the document, as inputs or targets, a token that two
    batches held twice; ``n_tokens`` those that were inputs, of which a step holds each once."""
    size = bin_tokens or spec.B * spec.T
    inputs, reach = spec.B * spec.T, spec.B * spec.T + spec.N
    reads = schedule.select("step", "rank", "shard_id", F.col("pos").alias("lo"), (F.col("pos") + F.lit(reach)).alias("hi"), (F.col("pos") + F.lit(inputs)).alias("end"))
    docs = spans.select("source_ord", "doc_ord", "shard_id", F.col("pos").alias("lo"), (F.col("pos") + F.col("length")).alias("hi"))
    left = _binned(reads, size).select("step", "rank", "end", "shard_id", "bin", F.col("lo").alias("read_lo"), F.col("hi").alias("read_hi"))
    both = left.join(_binned(docs, size), ["shard_id", "bin"])
    a, b = F.greatest("read_lo", "lo"), F.least("read_hi", "hi")
    both = both.where(b > a)
    held = F.greatest(F.lit(0), F.least(b, F.col("end")) - a)
    return both.groupBy("step", "rank", "source_ord", "doc_ord").agg(F.sum(b - a).cast("long").alias("n_read"), F.sum(held).cast("long").alias("n_tokens"))
