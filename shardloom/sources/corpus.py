"""Corpus scan (A1), key projection (B1), key joining (B2, B3), instruction
pairs and the ordered union of datasets (G5).

Every document row carries explicit order keys ``(source_ord, doc_ord)``:
Spark rows have no order, and the token stream's order is its meaning.
"""

from __future__ import annotations

from typing import Iterable, Optional, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DatasetSpec
from ..plans.ordering import row_index

DOC_COLUMNS = ("source_ord", "doc_ord", "text")


def scan_corpus(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """A1: read one text dataset; the row filter and the projection reach the
    Parquet scan (PushedFilters / ReadSchema)."""
    df = spark.read.format(spec.fmt).load(spec.path)
    if spec.where:
        df = df.where(spec.where)
    return df


def project_keys(df: DataFrame, data_keys: Sequence[str], order_col: str) -> DataFrame:
    """B1: keep the order column and a run-time list of text columns.

    A missing column raises ``AnalysisException`` (the reference raises
    ``KeyError``)."""
    return df.select(F.col(order_col).alias("doc_ord"), *[F.col(k) for k in data_keys])


def number_rows(df: DataFrame, order_cols: Sequence[str] = (), out_col: str = "doc_ord") -> DataFrame:
    """Order column at ingest: 0-based numbers of the rows by ``order_cols``
    (any sortable types, together unique), or as they stand in the files of a
    Parquet table (file path, then row number) when none are given.  The
    numbering is staged, so it is the same for every later reader."""
    if order_cols:
        return row_index(df, [], list(order_cols), out_col)
    place = ["_file", "_row"]
    placed = df.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    return row_index(placed, [], place, out_col).drop(*place)


def join_keys(cols: Sequence[str], separator: str = " ") -> Column:
    """Join text columns with a separator.  ``concat`` (not
    ``concat_ws``) so a null field gives a null document, as the reference
    fails on it rather than skipping it (quirk Q1)."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        if i and separator:
            parts.append(F.lit(separator))
        parts.append(F.col(c))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def require_text(df: DataFrame, on_null: str = "raise") -> DataFrame:
    """Null documents raise by default; ``on_null='drop'`` removes them."""
    if on_null == "drop":
        return df.where(F.col("text").isNotNull())
    if on_null != "raise":
        raise ValueError("on_null must be 'raise' or 'drop'")
    return df.withColumn(
        "text",
        F.when(F.col("text").isNull(),
               F.raise_error(F.concat(F.lit("null text field in document "),
                                      F.col("doc_ord").cast("string"))))
        .otherwise(F.col("text")))


def documents(spark: SparkSession, spec: DatasetSpec, source_ord: int = 0,
              on_null: str = "raise") -> DataFrame:
    """A1 + B1 + B2: ``(source_ord, doc_ord, text)`` of one dataset."""
    df = scan_corpus(spark, spec)
    if spec.order_col is None:
        df = number_rows(df.select(*spec.data_keys), out_col="_doc_ord")
    df = project_keys(df, spec.data_keys, spec.order_col or "_doc_ord")
    df = df.select(F.lit(source_ord).cast("int").alias("source_ord"),
                   F.col("doc_ord").cast("long").alias("doc_ord"),
                   join_keys(spec.data_keys, spec.separator).alias("text"))
    return require_text(df, on_null)


#: Places of a conversation's turns in ``doc_ord``; longer conversations widen it for the whole table.
TURN_STRIDE = 65536


def instruction_pairs(conversations: DataFrame, max_turns: int | None = None) -> DataFrame:
    """A ``user`` turn and the ``assistant`` turn right after it in the same
    conversation become one ``(doc_ord, instruction, output)`` row.

    ``doc_ord = conv_id * stride + turn`` keeps (conv_id, turn) order in one
    long.  The stride is ``TURN_STRIDE``, or one more than the greatest turn
    number of the table where that is larger, so a conversation may have any
    length; with ``max_turns`` it is that number, and a later turn raises.  A
    negative turn raises, and so does an order key beyond 63 bits.  The
    equi-join is on the unique ``(conv_id, turn)`` pair, so no conversation is
    a hot key.
    """
    if max_turns is None:
        max_turns = max(TURN_STRIDE, (conversations.agg(F.max("turn")).first()[0] or 0) + 1)
    user = conversations.where(F.col("role") == "user").select(
        "conv_id", F.col("turn").alias("u_turn"), F.col("text").alias("instruction"))
    asst = conversations.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("u_turn"), F.col("text").alias("output"))
    pairs = user.join(asst, ["conv_id", "u_turn"], "inner")
    wide = F.try_add(F.try_multiply(F.col("conv_id").cast("long"), F.lit(max_turns).cast("long")), F.col("u_turn").cast("long"))
    doc_ord = (F.when((F.col("u_turn") < 0) | (F.col("u_turn") >= max_turns),
                      F.raise_error(F.lit("conversation turn out of range for doc_ord")))
               .otherwise(F.coalesce(wide, F.raise_error(F.lit("doc_ord of a conversation needs more than 63 bits")))))
    return pairs.select(doc_ord.cast("long").alias("doc_ord"), "instruction", "output")


def pair_documents(conversations: DataFrame, source_ord: int = 0,
                   separator: str = " ", on_null: str = "raise") -> DataFrame:
    """Instruction pairs as documents: keys ``instruction, output`` joined with
    one space as in corpus preparation (B2); ``separator=""`` is the plain
    ``instruction + output`` pairing (B3)."""
    pairs = instruction_pairs(conversations)
    df = pairs.select(F.lit(source_ord).cast("int").alias("source_ord"), "doc_ord",
                      join_keys(["instruction", "output"], separator).alias("text"))
    return require_text(df, on_null)


def union_sources(frames: Iterable[DataFrame]) -> DataFrame:
    """Ordered union; each frame already carries its ``source_ord``, so all of
    dataset 0 precedes dataset 1 in the token stream."""
    frames = list(frames)
    if not frames:
        raise ValueError("no datasets given")
    out: Optional[DataFrame] = None
    for f in frames:
        f = f.select(*DOC_COLUMNS)
        out = f if out is None else out.unionByName(f)
    return out


def text_documents(spark: SparkSession, sf_dir: str, source_ord: int = 0,
                   where: Optional[str] = None) -> DataFrame:
    """The driver's ``documents`` table as a web-text dataset (key ``text``)."""
    spec = DatasetSpec(path=f"{sf_dir}/documents.parquet", data_keys=["text"],
                       order_col="doc_id", where=where)
    return documents(spark, spec, source_ord)


def conversation_documents(spark: SparkSession, sf_dir: str, source_ord: int = 0,
                           separator: str = " ") -> DataFrame:
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return pair_documents(conv, source_ord, separator)
