"""Token-shard sink (A2), scan (A3), catalog (A4, G1, B8) and split-label
names (A6, A7).

Shards are Parquet partitioned by ``data_name``, ``split`` and ``shard_id``: a
reader of one split opens only that split's folders (partition pruning, the
reference's glob by suffix), and a shard is one file whose fragments are
sorted by position.  Writing one data name leaves the others of the store
alone.  The manifest is written beside the data in ``_manifest`` (a hidden
folder for readers of the data).  No files are renamed: the split is a
partition value and the labelled name a column.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SPLIT_LABELS, SplitRatio
from ..functions.names import split_of, strip_split_label, with_split_label


# Column types of a shard table, partition columns included (so a shard id is
# read back as bigint rather than whatever partition inference guesses).
SHARD_SCHEMA = ("pos bigint, length bigint, source_ord int, doc_ord bigint, tokens array<int>, "
                "data_name string, split string, shard_id bigint")


def write_shards(fragments: DataFrame, manifest: DataFrame, path: str, data_name: str) -> None:
    """A2: every shard of a data name is written, the last partial one
    included, replacing what the store had under that name.

    One shuffle brings a shard's fragments together (a shard has a fixed
    number of tokens, so no group is hot) and each shard becomes one file.  The
    number of partitions is named: each file costs its own time to open, which
    a coalescing by bytes would not see."""
    top = path.rstrip("/")
    parts = int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = ["split", "shard_id", "pos", F.size("tokens").cast("long").alias("length"), "source_ord", "doc_ord", "tokens"]
    (fragments.select(*cols).repartition(parts, "split", "shard_id").sortWithinPartitions("split", "shard_id", "pos")
     .write.mode("overwrite").partitionBy("split", "shard_id").parquet(f"{top}/data_name={data_name}"))
    manifest.drop("data_name").write.mode("overwrite").parquet(f"{top}/_manifest/data_name={data_name}")


def read_manifest(spark: SparkSession, path: str, data_name: Optional[str] = None) -> DataFrame:
    """The manifest of all data names of a store, or of one."""
    df = spark.read.parquet(f"{path.rstrip('/')}/_manifest").withColumn("data_name", F.col("data_name").cast("string"))
    return df if data_name is None else df.where(F.col("data_name") == F.lit(data_name))


def only_data_name(spark: SparkSession, path: str) -> str:
    """The data name of a store that has one; several have to be told apart by the caller."""
    names = [r.data_name for r in read_manifest(spark, path).select("data_name").distinct().limit(2).collect()]
    if len(names) != 1:
        raise ValueError(f"the store holds {len(names) or 'no'} data names or more: name one of them")
    return names[0]


def read_shards(spark: SparkSession, path: str, split: Optional[str] = None,
                widen_to: str = "int", data_name: Optional[str] = None) -> DataFrame:
    """A3 + B5: fragments of one split and data name (partition filters) with
    tokens widened (``int`` as stored, or ``long``)."""
    df = spark.read.schema(SHARD_SCHEMA).parquet(path)
    if data_name is not None:
        df = df.where(F.col("data_name") == F.lit(data_name))
    if split is not None:
        if split not in SPLIT_LABELS:
            raise ValueError(f"unknown split {split!r}")
        df = df.where(F.col("split") == F.lit(split))
    return df.withColumn("tokens", F.col("tokens").cast(f"array<{widen_to}>"))


def shard_catalog(manifest: DataFrame, split: Optional[str] = None,
                  data_name: Optional[str] = None) -> DataFrame:
    """A4 + G1 + B8: shards of a data name (exact match, quirk Q5), optionally
    of one split, in name order (zero-padded names sort as ``shard_id``)."""
    df = manifest
    if data_name is not None:
        df = df.where(F.col("data_name") == F.lit(data_name))
    if split is not None:
        if split not in SPLIT_LABELS:
            raise ValueError(f"unknown split {split!r}")
        df = df.where(F.col("split") == F.lit(split))
    return df.orderBy("shard_id")


def require_shards(catalog: DataFrame, split: str, data_name: Optional[str] = None) -> None:
    """A loader needs at least one shard of its split and data name (one-row probe)."""
    if not catalog.limit(1).collect():
        raise ValueError(f"nothing to load: split {split!r}" + (f" of {data_name!r} is empty" if data_name else " is empty"))


def loader_report(manifest: DataFrame, data_names, splits=SPLIT_LABELS) -> DataFrame:
    """B9, report form: whether a loader finds shards for each of the given
    data names and splits."""
    spark = manifest.sparkSession
    asked = spark.createDataFrame([(n, s) for n in data_names for s in splits], "data_name string, split string")
    found = manifest.groupBy("data_name", "split").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(found, ["data_name", "split"], "left").select(
        "data_name", "split", F.coalesce("n", F.lit(0)).alias("n_shards"), F.col("n").isNotNull().alias("loadable"))


def strip_label(name: Column) -> Column:
    """A6 on a file name."""
    return strip_split_label(name)


def resplit_manifest(manifest: DataFrame, ratio: SplitRatio) -> DataFrame:
    """A6 + A7 + B6: strip the old labels from the file names and label the
    shards again with a new ratio.  Only the (small) manifest changes; the
    data stays where it is."""
    base = strip_split_label(F.col("file_name"))
    split = split_of(F.col("shard_id"), ratio)
    return (manifest.withColumn("split", split)
            .withColumn("file_name", with_split_label(base, split)))


def read_split_by_manifest(spark: SparkSession, path: str, manifest: DataFrame, split: str,
                           widen_to: str = "int") -> DataFrame:
    """A3 for a manifest whose labels differ from the folder layout: a
    left-semi join on ``shard_id`` (a partition column), which lets the
    planner apply dynamic partition pruning where it judges it useful.  The
    manifest grows with the shard count, so no broadcast is forced."""
    if split not in SPLIT_LABELS:
        raise ValueError(f"unknown split {split!r}")
    wanted = manifest.where(F.col("split") == F.lit(split)).select("shard_id")
    df = spark.read.schema(SHARD_SCHEMA).parquet(path).drop("split").join(wanted, "shard_id", "left_semi")
    return df.withColumn("split", F.lit(split)).withColumn("tokens", F.col("tokens").cast(f"array<{widen_to}>"))
