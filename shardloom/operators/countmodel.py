"""Next-token count model: pair counts (D9), test-split cross-entropy (D10),
top-k candidates (E6) and probabilities (E7).

It stands in for the reference's training pass: "train on the training split,
report loss on the test split" stays a distributed data job.  Pairs are the
``(x_i, y_i)`` of full windows, so they cross documents through the
end-of-text token but never a shard.

Scale notes: a task counts the targets of its sequences ``TARGETS_AT_ONCE`` at
a time (Arrow batches, one sort of packed pairs) before groups by a hash of the
pair add them up: no row is made for a target, and a hot context or pair
collapses before the shuffle.
Context totals have at most ``vocab_size`` rows (ids are capped below 65,536),
the one size bound that lets them be broadcast.  Probabilities use those totals
through that bounded join instead of a window over a possibly huge context.
"""

from __future__ import annotations

import math
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TOKEN_LIMIT, TOP_K
from ..session import ship_package

# Targets that a task counts at once (more where one Arrow batch holds more).
TARGETS_AT_ONCE = 1 << 21
# Ids below this and this many groups are sorted as one 64-bit integer.
PACKED_BITS, PACKED_GROUPS = 24, 1 << 15
# Parts of the pairs whose counts are added up together, for each shuffle partition and at least; rows of lists in an Arrow batch.
PARTS_PER_PARTITION, LEAST_PARTS = 8, 64
ROWS_AT_ONCE = 1 << 10


def _check_vocab(vocab_size: int) -> None:
    if not 0 < vocab_size <= TOKEN_LIMIT:
        raise ValueError("vocab_size must be in (0, 65536]")


def _same_length() -> Column:
    """x where y is as long; otherwise the job fails."""
    return F.when(F.size("x") == F.size("y"), F.col("x")).otherwise(F.raise_error(F.lit("x and y differ in length")))


def unfolded(seqs: DataFrame, *keep: str) -> DataFrame:
    """``(keep..., a, b)`` per target position: x is unfolded and y asked at
    the same place, so no struct is made for a token.  x and y are as long as
    each other; otherwise the job fails."""
    z = seqs.select(*keep, "y", F.posexplode(_same_length()).alias("_j", "a"))
    return z.select(*keep, "a", F.get("y", F.col("_j")).alias("b"))


def pair_table(seqs: DataFrame) -> DataFrame:
    """``(a, b)`` per target position of the given sequences."""
    return unfolded(seqs)


def _distinct(group: np.ndarray, a: pa.Array, b: pa.Array, c: np.ndarray | None = None) -> tuple:
    """Distinct ``(group, a, b)`` and the sum of their ``c`` (how often each occurs where none is given)."""
    if not a.null_count and not b.null_count:
        x, y = a.to_numpy(), b.to_numpy()
        if min(x.min(), y.min()) >= 0 and max(x.max(), y.max()) < 1 << PACKED_BITS and group.max() < PACKED_GROUPS:
            packed = (group << 2 * PACKED_BITS) | (x.astype(np.int64) << PACKED_BITS) | y
            if c is None:
                packed.sort()
            else:
                order = np.argsort(packed)
                packed, c = packed[order], c[order]
            at = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
            n = np.diff(np.append(at, len(packed))) if c is None else np.add.reduceat(c, at)
            packed, low = packed[at], (1 << PACKED_BITS) - 1
            return (packed >> 2 * PACKED_BITS, pa.array((packed >> PACKED_BITS) & low).cast(a.type),
                    pa.array(packed & low).cast(b.type), n)
    # nulls, and ids that do not pack
    rows = pa.table({"k": group, "a": a, "b": b, "c": np.ones(len(a), np.int64) if c is None else c})
    found = rows.group_by(["k", "a", "b"], use_threads=False).aggregate([("c", "sum")])
    k, a, b, n = (found[name].combine_chunks() for name in ("k", "a", "b", "c_sum"))
    return k.to_numpy(), a, b, n.to_numpy()


def _count_targets(rows: pa.Table, keys: Sequence[str], parts: int) -> pa.Table:
    """``(keys..., part, a, b, c)`` of some sequences, a row for each part that has pairs."""
    rows = rows.combine_chunks()
    x, y = (rows[name].chunk(0) for name in ("x", "y"))
    code = np.zeros(len(rows), np.int64)
    for k in keys:
        seen = rows[k].chunk(0).dictionary_encode(null_encoding="encode")
        _, code = np.unique(code * len(seen.dictionary) + seen.indices.to_numpy(), return_inverse=True)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    group, a, b, n = _distinct(np.repeat(code, pc.fill_null(pc.list_value_length(x), 0).to_numpy()), x.flatten(), y.flatten())
    u, v = (pc.fill_null(ids, -1).to_numpy().astype(np.uint64) for ids in (a, b))
    part = (((u << np.uint64(32)) ^ v) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % parts
    place = group * parts + part
    order = np.argsort(place, kind="stable")
    at = np.flatnonzero(np.diff(place[order], prepend=-1))
    ends = pa.array(np.append(at, len(order)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, ids.take(pa.array(order))) for ids in (a, b, pa.array(n, pa.int64()))]
    held = pa.array(first[group[order[at]]])
    return pa.table([*(rows[k].chunk(0).take(held) for k in keys), pa.array(part[order[at]], pa.int32()), *lists],
                    names=[*keys, "part", "a", "b", "c"])


def pair_counts(seqs: DataFrame, *keys: str) -> DataFrame:
    """``(keys..., a, b, c)`` over the targets of the given sequences.  Tasks
    count their own; what they found is dealt by a hash of the pair into parts,
    whose counts are then added up, so no part holds more than its share of the
    distinct pairs of each task.  x and y are as long as each other; otherwise
    the job fails."""
    spark = seqs.sparkSession
    ship_package(spark)
    parts = max(LEAST_PARTS, PARTS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = seqs.select(*keys, _same_length().alias("x"), "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted():
            if size:
                yield from _count_targets(pa.Table.from_batches(held), keys, parts).to_batches(max_chunksize=ROWS_AT_ONCE)

        for batch in batches:
            more = pc.sum(pc.list_value_length(batch.column("x"))).as_py() or 0
            if size + more > TARGETS_AT_ONCE:
                yield from counted()
                held, size = [], 0
            held, size = [*held, batch], size + more
        yield from counted()

    def add_up(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        a, b, c = (part[name].chunk(0).flatten() for name in ("a", "b", "c"))
        _, a, b, n = _distinct(np.zeros(len(a), np.int64), a, b, c.to_numpy())
        of = pa.array(np.zeros(len(a), np.int64))
        return pa.table([*(part[k].chunk(0).take(of) for k in keys), a, b, pa.array(n, pa.int64())], names=[*keys, "a", "b", "c"])

    held = [rows.schema[k] for k in keys]
    kinds = {out: rows.schema[name].dataType.elementType for out, name in (("a", "x"), ("b", "y"))} | {"c": T.LongType()}
    lists = [T.StructField(name, T.ArrayType(kind)) for name, kind in kinds.items()]
    found = rows.mapInArrow(count, T.StructType([*held, T.StructField("part", T.IntegerType()), *lists]))
    sums = T.StructType([*held, *(T.StructField(name, kind) for name, kind in kinds.items())])
    return found.groupBy(*keys, "part").applyInArrow(add_up, sums)


def next_token_counts(seqs: DataFrame) -> DataFrame:
    """``(a, b, c)`` over the given (training) sequences."""
    return pair_counts(seqs)


def split_pair_counts(seqs: DataFrame) -> DataFrame:
    """D9 for every split at once: ``(split, a, b, c)``; the training counts
    and the test targets then come from one pass over the sequences."""
    return pair_counts(seqs, "split")


def context_totals(counts: DataFrame) -> DataFrame:
    """``(a, ca)``: at most vocab_size rows."""
    return counts.groupBy("a").agg(F.sum("c").cast("long").alias("ca"))


def next_token_probs(counts: DataFrame, vocab_size: int) -> DataFrame:
    """``p = c / sum_b c`` per context, via the bounded context table."""
    _check_vocab(vocab_size)
    tot = context_totals(counts)
    return (counts.join(tot, "a")
            .select("a", "b", "c", (F.col("c") / F.col("ca")).alias("p")))


def topk_next(counts: DataFrame, k: int = TOP_K) -> DataFrame:
    """The ``k`` most frequent next tokens per context, ties by smaller id:
    ``(a, rnk, b, c)``.  ``row_number() <= k`` lets Catalyst insert a partial
    window group limit before the shuffle, so a context with many successors
    sends at most ``k`` rows per task."""
    w = Window.partitionBy("a").orderBy(F.desc("c"), F.asc("b"))
    return (counts.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)
            .select("a", "rnk", "b", "c"))


def backoff_topk(counts: DataFrame, k: int = TOP_K) -> DataFrame:
    """The ``k`` most frequent next tokens overall ``(rnk, b, c)``, used when a
    context was never seen (a count table, unlike a network, has no
    distribution there)."""
    totals = counts.groupBy("b").agg(F.sum("c").cast("long").alias("c"))
    top = totals.orderBy(F.desc("c"), F.asc("b")).limit(k)
    w = Window.orderBy(F.desc("c"), F.asc("b"))
    return top.select(F.row_number().over(w).alias("rnk"), "b", "c")


def cross_entropy(test_seqs: DataFrame, counts: DataFrame, vocab_size: int) -> DataFrame:
    """Mean of ``-ln p(b|a)`` over all test targets, add-one smoothing
    ``p = (c(a,b)+1) / (c(a)+V)``: one row ``(n_targets, cross_entropy)``."""
    test = next_token_counts(test_seqs).withColumnRenamed("c", "n")
    return cross_entropy_counts(test, counts, vocab_size)


def cross_entropy_counts(test: DataFrame, counts: DataFrame, vocab_size: int) -> DataFrame:
    """D10 from aggregated test targets ``(a, b, n)``: the join is between two
    tables of distinct pairs (no hot key); context totals are bounded by V."""
    _check_vocab(vocab_size)
    tot = context_totals(counts)
    j = (test.join(counts, ["a", "b"], "left").join(tot, "a", "left")
         .select("n", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("ca", F.lit(0)).alias("ca")))
    nll = -F.log((F.col("c") + F.lit(1.0)) / (F.col("ca") + F.lit(float(vocab_size))))
    return j.agg(F.sum("n").cast("long").alias("n_targets"),
                 (F.sum(F.col("n") * nll) / F.sum("n")).alias("cross_entropy"))
