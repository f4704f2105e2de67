"""Global offsets (E1), fixed-size shard packing (E2), the shard manifest
and split labels (B6-B8, D2, Q10).

A document ``(g, n)`` (``g`` its global token offset) touches shards
``g div S .. (g+n-1) div S``; it becomes one *fragment* per shard touched, so
the row count grows with documents + shards, never with tokens.  The closed
form equals the reference's sequential fill (an exact fit closes the shard,
the remainder opens the next one) and has no limit on document length.
"""

from __future__ import annotations

from functools import reduce
from typing import Optional

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SPLIT_LABELS, PackSpec, SplitRatio
from ..functions.names import shard_name, split_of, with_split_label
from ..plans.ordering import with_offsets
from ..session import stage_table
from .tokenize import Tokenizer, tokenize_documents


def stage_token_table(docs: DataFrame, tok: Tokenizer) -> DataFrame:
    """``(source_ord, doc_ord, tokens, n)`` encoded once and written: for
    tokenizers whose counts need the encoder (byte-pair), every later use —
    counts, offsets, fragments — reads this table instead of encoding again."""
    return stage_table(tokenize_documents(docs, tok), "doc-tokens")


def doc_offsets(docs: DataFrame, tok: Tokenizer, spec: PackSpec = PackSpec(),
                tokenized: bool = False) -> DataFrame:
    """E1 on the slim table ``(source_ord, doc_ord, n, g)``; ``tokenized=True``
    takes a ``(source_ord, doc_ord, tokens, n)`` table and reads only ``n``."""
    if not tokenized and not tok.jvm_count:
        # counting needs the encoder itself: encode once into a staged table
        docs, tokenized = stage_token_table(docs, tok), True
    n = F.col("n") if tokenized else tok.count(F.col("text")).alias("n")
    return with_offsets(docs.select("source_ord", "doc_ord", n), "n", spec.ranges)


def _touched_shards(g: Column, n: Column, S: int) -> Column:
    return F.explode(F.sequence(F.expr(f"g div {S}"), F.expr(f"(g + n - 1) div {S}")))


def _fragment_bounds(df: DataFrame, S: int) -> DataFrame:
    df = df.withColumn("shard_id", _touched_shards(F.col("g"), F.col("n"), S))
    lo = F.greatest(F.col("g"), F.col("shard_id") * F.lit(S))
    hi = F.least(F.col("g") + F.col("n"), (F.col("shard_id") + F.lit(1)) * F.lit(S))
    return (df.withColumn("_lo", lo).withColumn("_hi", hi)
            .withColumn("pos", F.col("_lo") - F.col("shard_id") * F.lit(S)))


def fragment_spans(offsets: DataFrame, S: int) -> DataFrame:
    """Token-free fragments ``(source_ord, doc_ord, shard_id, pos, length)``."""
    df = _fragment_bounds(offsets, S)
    return df.select("source_ord", "doc_ord", "shard_id", "pos",
                     (F.col("_hi") - F.col("_lo")).alias("length"))


def pack_fragments(docs: DataFrame, tok: Tokenizer, spec: PackSpec = PackSpec(),
                   tokenized: bool = False) -> DataFrame:
    """``(source_ord, doc_ord, shard_id, pos, tokens)``.

    With a tokenizer that counts JVM-side, offsets are computed on the text
    rows (one shuffle, by prefix-sum range) and tokens are encoded after it,
    in the same stage that slices fragments.  ``tokenized=True`` takes an
    already staged ``(source_ord, doc_ord, tokens, n)`` table instead.
    """
    S = spec.shard_tokens
    if not tokenized and not tok.jvm_count:
        # counting needs the encoder itself: encode once into a staged table
        docs, tokenized = stage_token_table(docs, tok), True
    if tokenized:
        rows = docs
    else:
        rows = docs.withColumn("n", tok.count(F.col("text")))
    rows = with_offsets(rows, "n", spec.ranges)
    if not tokenized:
        rows = rows.withColumn("tokens", tok.encode(F.col("text"))).drop("text")
    return fragments_at(rows, S)


def fragments_at(rows: DataFrame, S: int) -> DataFrame:
    """E2 for documents whose offsets ``g`` are known."""
    df = _fragment_bounds(rows, S)
    start = (F.col("_lo") - F.col("g") + F.lit(1)).cast("int")
    length = (F.col("_hi") - F.col("_lo")).cast("int")
    return df.select("source_ord", "doc_ord", "shard_id", "pos",
                     F.slice("tokens", start, length).alias("tokens"))


def shard_manifest(offsets: DataFrame, spec: PackSpec = PackSpec(),
                   ratio: Optional[SplitRatio] = SplitRatio()) -> DataFrame:
    """D1 + A5 + A7 + B6: one row per shard from the token-free offsets
    ``(source_ord, doc_ord, n, g)``:
    ``(data_name, shard_id, shard_name, split, file_name, n_tokens, n_docs)``."""
    spans = fragment_spans(offsets, spec.shard_tokens)
    agg = spans.groupBy("shard_id").agg(
        F.sum("length").cast("long").alias("n_tokens"),
        F.count(F.lit(1)).alias("n_docs"))
    return named_manifest(agg, spec, ratio)


def named_manifest(sizes: DataFrame, spec: PackSpec, ratio: Optional[SplitRatio]) -> DataFrame:
    """A5 + A7 + B6: ``(shard_id, n_tokens, n_docs)`` with names and labels."""
    name = shard_name(spec.data_name, F.col("shard_id"))
    out = sizes.select(F.lit(spec.data_name).alias("data_name"), "shard_id",
                     name.alias("shard_name"), "n_tokens", "n_docs")
    if ratio is not None:
        out = out.withColumn("split", split_of(F.col("shard_id"), ratio))
        out = out.withColumn("file_name", with_split_label(F.col("shard_name"), F.col("split")))
    return out


def label_splits(df: DataFrame, ratio: SplitRatio = SplitRatio(),
                 shard_col: str = "shard_id") -> DataFrame:
    """Add ``split`` to any table keyed by shard."""
    return df.withColumn("split", split_of(F.col(shard_col), ratio))


def split_counts(manifest: DataFrame) -> DataFrame:
    """Shards (and tokens) per split."""
    return manifest.groupBy("split").agg(F.count(F.lit(1)).alias("n_shards"),
                                         F.sum("n_tokens").cast("long").alias("n_tokens"))


def check_split_coverage(manifest: DataFrame, ratio: SplitRatio,
                         allow_empty: bool = False) -> dict:
    """Raise when a split with a non-zero share got no shard.  One
    tiny aggregate (three rows) reaches the driver."""
    counts = {r["split"]: r["n_shards"] for r in split_counts(manifest).collect()}
    wanted = dict(zip(SPLIT_LABELS, (ratio.training, ratio.validation, ratio.testing)))
    empty = [s for s, share in wanted.items() if share and not counts.get(s)]
    if empty and not allow_empty:
        raise ValueError(f"no shards for split(s) {empty}; found {counts}")
    return counts


def filter_split(df: DataFrame, split: str) -> DataFrame:
    """Rows of one split (a partition filter when the table is written
    partitioned by ``split``)."""
    if split not in SPLIT_LABELS:
        raise ValueError(f"unknown split {split!r}")
    return df.where(F.col("split") == F.lit(split))


def ratio_report(manifest: DataFrame, ratios) -> DataFrame:
    """B7, report form: for each ratio ``(training, validation, testing)``
    whether it is one, and the shards and tokens each split would get:
    ``(ratio, valid, split, n_shards, n_tokens)``; a ratio that is none has one row."""
    parts = []
    for ratio in ratios:
        name = F.lit(":".join(map(str, ratio))).alias("ratio")
        try:
            label = split_of(F.col("shard_id"), SplitRatio(*ratio))
        except ValueError:
            row = manifest.agg(F.lit(False).alias("valid"))
            none = lambda kind, out: F.lit(None).cast(kind).alias(out)
            parts.append(row.select(name, "valid", none("string", "split"), none("long", "n_shards"), none("long", "n_tokens")))
            continue
        parts.append(split_counts(manifest.select(label.alias("split"), "n_tokens")).select(name, F.lit(True).alias("valid"), "split", "n_shards", "n_tokens"))
    return reduce(DataFrame.unionByName, parts)
