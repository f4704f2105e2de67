"""End-to-end jobs: the three programs of the reference as Spark jobs.

``prepare_corpus``  datasets -> documents -> tokens -> packed shards + manifest,
                    split-labelled, written under ``out`` (corpus preparation).
``load_split``      the fragments of one split, checked non-empty (the loader).
``train_count_model`` / ``evaluate``  the count model on the training split,
                    its cross-entropy on the testing split (train and test).
``generate_responses``  prompts x runs -> seeded top-k text (evaluation).

Each stage is a DataFrame plan; writes go to the caller's ``out`` folder.
"""

from __future__ import annotations

from typing import Optional, Sequence, Union

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DatasetSpec, PackSpec, SplitRatio, WindowSpec
from ..operators import countmodel as CM
from ..operators import generate as GE
from ..operators import packing as PK
from ..operators.tokenize import Tokenizer, WordTokenizer, get_tokenizer
from ..operators.windows import sequences
from ..session import stage_table
from ..sources import corpus as CO
from ..sources import shards as SH
from ..sources import store as ST


def corpus_documents(spark: SparkSession, datasets: Sequence[DatasetSpec]) -> DataFrame:
    """G5 over the configured datasets, in list order."""
    return CO.union_sources([CO.documents(spark, d, i) for i, d in enumerate(datasets)])


def prepare_corpus(spark: SparkSession, datasets: Sequence[DatasetSpec], out: str,
                   tokenizer: Union[str, Tokenizer] = "word", pack: PackSpec = PackSpec(),
                   ratio: SplitRatio = SplitRatio(), allow_empty_split: bool = False,
                   **tokenizer_args) -> DataFrame:
    """Write shards (partitioned by split and shard) and the manifest of one
    data name; return its manifest as read back.  Raises before anything is
    written when a split with a share would get no shard (unless
    ``allow_empty_split``).

    The raw text is read once to encode it (a word tokenizer also reads it
    once to count words); offsets come from the staged counts alone, and the
    staged tokens join them once to become fragments."""
    docs = corpus_documents(spark, datasets)
    tok = tokenizer if isinstance(tokenizer, Tokenizer) else get_tokenizer(tokenizer, docs, **tokenizer_args)
    tokens = PK.stage_token_table(docs, tok)
    offsets = stage_table(PK.doc_offsets(tokens, tok, pack, tokenized=True), "doc-offsets")
    manifest = PK.shard_manifest(offsets, pack, ratio)
    PK.check_split_coverage(manifest, ratio, allow_empty_split)
    placed = tokens.join(offsets.drop("n"), ["source_ord", "doc_ord"])
    frags = PK.label_splits(PK.fragments_at(placed, pack.shard_tokens), ratio)
    ST.create(frags, manifest, out, pack.data_name)
    save_tokenizer(spark, tok, out)
    return ST.manifest_of(spark, out, pack.data_name)


def save_tokenizer(spark: SparkSession, tok: Tokenizer, out: str) -> None:
    """Keep what encodes prompts and decodes output with the corpus's ids: the
    tokenizer's name (``_tokenizer``) and a word tokenizer's vocabulary."""
    spark.createDataFrame([(tok.name,)], "name string").write.mode("overwrite").parquet(f"{out.rstrip('/')}/_tokenizer")
    if isinstance(tok, WordTokenizer):
        save_vocabulary(spark, tok, out)


def load_tokenizer(spark: SparkSession, out: str, **tokenizer_args) -> Tokenizer:
    """The tokenizer a corpus was prepared with; ``bpe`` needs its ranks again."""
    name = spark.read.parquet(f"{out.rstrip('/')}/_tokenizer").first().name
    return load_word_tokenizer(spark, out) if name == "word" else get_tokenizer(name, **tokenizer_args)


def save_vocabulary(spark: SparkSession, tok: WordTokenizer, out: str) -> None:
    """Keep the word ids with the shards (``_vocab``)."""
    rows = [(i + 1, w) for i, w in enumerate(tok.words)]          # at most the cap
    (spark.createDataFrame(rows, "id int, word string").coalesce(1)
     .write.mode("overwrite").parquet(f"{out.rstrip('/')}/_vocab"))
    spark.createDataFrame([(tok.cap,)], "cap int").write.mode("overwrite").parquet(f"{out.rstrip('/')}/_vocab_cap")


def load_word_tokenizer(spark: SparkSession, out: str) -> WordTokenizer:
    """The word tokenizer a corpus was prepared with."""
    cap = spark.read.parquet(f"{out.rstrip('/')}/_vocab_cap").collect()[0].cap
    rows = spark.read.parquet(f"{out.rstrip('/')}/_vocab").orderBy("id").limit(cap + 1).collect()
    if len(rows) > cap:
        raise ValueError("stored vocabulary longer than its cap")
    return WordTokenizer(spark, [r.word for r in rows], cap)


def load_split(spark: SparkSession, out: str, split: str, data_name: Optional[str] = None) -> DataFrame:
    """B8 + B9 + A3: fragments of one split of a data name (the only one in
    the store when not given); fails when the name or the split is missing."""
    name = SH.only_data_name(spark, out) if data_name is None else data_name
    if not ST.versions(spark, out, name):
        raise ValueError(f"nothing to load: {name!r} is empty")
    SH.require_shards(SH.shard_catalog(ST.manifest_of(spark, out, name), split, name), split, name)
    return ST.read_split(spark, out, name, split)


def split_sequences(spark: SparkSession, out: str, split: str, spec: WindowSpec,
                    data_name: Optional[str] = None) -> DataFrame:
    return sequences(load_split(spark, out, split, data_name), spec.T, spec.N)


def train_count_model(spark: SparkSession, out: str, spec: WindowSpec,
                      model_path: Optional[str] = None, data_name: Optional[str] = None) -> DataFrame:
    """D9 on the training split; written to ``model_path`` when given."""
    counts = CM.next_token_counts(split_sequences(spark, out, "training", spec, data_name))
    if model_path:
        counts.write.mode("overwrite").parquet(model_path)
        return spark.read.parquet(model_path)
    return counts


def evaluate(spark: SparkSession, out: str, counts: DataFrame, spec: WindowSpec,
             vocab_size: int, data_name: Optional[str] = None) -> DataFrame:
    """D10 on the testing split: ``(n_targets, cross_entropy)``."""
    return CM.cross_entropy(split_sequences(spark, out, "testing", spec, data_name), counts, vocab_size)


def resplit(spark: SparkSession, out: str, ratio: SplitRatio, data_name: Optional[str] = None,
            allow_empty_split: bool = False) -> DataFrame:
    """A6 + A7 + B6 as a job: label the shards of a data name again with
    another ratio.  The new split of every shard is checked first; then a new
    version of the manifest is published, and no shard is read or written."""
    name = SH.only_data_name(spark, out) if data_name is None else data_name
    return ST.manifest_of(spark, out, name, ST.resplit(spark, out, name, ratio, allow_empty_split))


def generate_responses(prompts: DataFrame, tok: Tokenizer, counts: DataFrame, runs: Sequence[str],
                       max_length: int) -> DataFrame:
    """C2 + J3 + J4 for one count model: ``prompts(item_id, text)`` -> one row
    per prompt with a response column per run."""
    p = prompts.select("item_id", tok.encode(F.col("text"), eot=False).alias("tokens"))
    gen = GE.generate(GE.prompt_matrix(p, runs), CM.topk_next(counts), CM.backoff_topk(counts),
                      max_length, tok.vocab_size)
    return GE.responses_pivot(gen.withColumn("response", tok.decode(F.col("tokens"))), runs)
