"""From raw documents to their places in packed training sequences: five stages, each an operator of ``shardloom.llm`` on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns documents, the last one packed pieces; ``run`` writes each result to the shared
folder and reads it again for the next.  Labels are learnt from where they lie, beside the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import neardup, packing, quality, suffixdedup, toxicity
from shardloom.llm.common import free_name, staged
from shardloom.llm.queries import WORD_FILE
from shardloom.session import read_table, ship_package

#: Documents from this score on are rejected.
TOXIC = 0.5
END_ID = 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most toxic window scores below ``TOXIC``."""
    ship_package(spark)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    out = free_name(docs, "toxicity")
    return toxicity.score(docs, model, out=out).where(F.col(out) < TOXIC).drop(out)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects."""
    ship_package(spark)
    rules = quality.RULES + quality.BASE_RULES
    rules = quality.cascade(rules, quality.measure_rules(docs, rules))
    prefix = free_name(docs, "quality_")
    judged = quality.judge(docs, rules, full=False, prefix=prefix)
    return judged.where(F.col(f"{prefix}kept")).drop(f"{prefix}kept", f"{prefix}rejected_by")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates; rows that share an id and differ in text are documents of their own."""
    ship_package(spark)
    return neardup.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has too; ``n_chars`` follows the text."""
    ship_package(spark)
    cut = suffixdedup.cut_texts(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences; a text that the stage before emptied is its end token alone.

    The ids stay in the staged pieces (``packing.pack_documents`` with ``ids`` returns them, ``packing.sequences`` joins them)."""
    ship_package(spark)
    return packing.pack_documents(docs, WORD_FILE, END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("packing", pack),
]

#: The stages learn, estimate and tokenise: SQL can't express them; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
