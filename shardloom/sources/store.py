"""A7 + B6 as a versioned store: which split a shard belongs to is a line of a numbered manifest, and shards never move.

The reference renames files to label them again.  Here a store holds, for each data name N,

* ``data_name=N/split=S/shard_id=I``: the shards as ``write_shards`` lays them out, under the split of their first labels,
* ``_manifests/data_name=N/<unique>``: manifests, each whole and never changed,
* ``_versions/N/00000001`` ...: one small file a version, which names its manifest.

A version is published by creating its file, which the file system does for one writer only (``create`` without overwrite): who comes
second takes the next number.  So readers see the old version until the new one is whole; a job that stops before it publishes leaves
an unreferenced manifest and nothing else.  A reader may stay at a version.  Labelling again (``resplit``) writes a manifest and no token.

The first labels are read by folder (static pruning).  Later ones join the shards to the manifest by ``shard_id``, a folder name too,
so Spark prunes at run time; the manifest grows with the corpus and is broadcast only if the planner finds it small.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SPLIT_LABELS, SplitRatio
from ..operators.packing import check_split_coverage
from .shards import read_shards, read_split_by_manifest, resplit_manifest, write_shards

#: Begins the names of manifests whose labels are those of the folders.
_WRITTEN = "written-"


def _top(store: str, data_name: str, kind: str) -> str:
    return f"{store.rstrip('/')}/_versions/{data_name}" if kind == "versions" else f"{store.rstrip('/')}/_manifests/data_name={data_name}"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, store: str, data_name: str) -> list[int]:
    """The numbers of a data name's versions, in order; a driver-side listing of one small folder."""
    _, path, fs = _file_system(spark, _top(store, data_name, "versions"))
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n) for n in names if n.isdigit())


def _publish(spark: SparkSession, store: str, data_name: str, manifest: str) -> int:
    """Create the next version's file; where another writer was faster, the one after it."""
    number = max(versions(spark, store, data_name), default=0)
    while True:
        number += 1
        jvm, path, fs = _file_system(spark, f"{_top(store, data_name, 'versions')}/{number:08d}")
        try:
            out = fs.create(path, False)
        except Exception:
            if not fs.exists(path):
                raise
            continue
        try:
            out.write(bytearray(manifest.encode()))
        finally:
            out.close()
        return number


def _named(spark: SparkSession, store: str, data_name: str, version: int | None) -> str:
    """The manifest that a version names, the newest one by default."""
    known = versions(spark, store, data_name)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no version {version or ''} of {data_name!r}: {known[-3:]}")
    number = known[-1] if version is None else version
    _, path, fs = _file_system(spark, f"{_top(store, data_name, 'versions')}/{number:08d}")
    stream = fs.open(path)
    try:
        name = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    if not name:
        raise ValueError(f"version {number} of {data_name!r} is being published")
    return name


def manifest_of(spark: SparkSession, store: str, data_name: str, version: int | None = None) -> DataFrame:
    """The manifest of a version, the newest one by default."""
    name = _named(spark, store, data_name, version)
    return spark.read.parquet(f"{_top(store, data_name, 'manifests')}/{name}").withColumn("data_name", F.lit(data_name))


def _stage_manifest(spark: SparkSession, manifest: DataFrame, store: str, data_name: str, prefix: str = "") -> str:
    name = prefix + uuid.uuid4().hex
    manifest.drop("data_name").write.parquet(f"{_top(store, data_name, 'manifests')}/{name}")
    return name


def create(fragments: DataFrame, manifest: DataFrame, store: str, data_name: str) -> int:
    """A2: write the shards of a data name, replacing what was there, and publish the version that names them: data comes first."""
    spark = fragments.sparkSession
    write_shards(fragments, manifest, store, data_name)
    return _publish(spark, store, data_name, _stage_manifest(spark, manifest, store, data_name, _WRITTEN))


def resplit(spark: SparkSession, store: str, data_name: str, ratio: SplitRatio, allow_empty_split: bool = False) -> int:
    """A6 + A7 + B6: a new version whose labels follow another ratio; shards are neither read nor written."""
    new = resplit_manifest(manifest_of(spark, store, data_name), ratio)
    check_split_coverage(new, ratio, allow_empty_split)
    return _publish(spark, store, data_name, _stage_manifest(spark, new, store, data_name))


def read_split(spark: SparkSession, store: str, data_name: str, split: str, version: int | None = None, widen_to: str = "int") -> DataFrame:
    """A3 + B8: the fragments of a split as a version has it."""
    if split not in SPLIT_LABELS:
        raise ValueError(f"unknown split {split!r}")
    if _named(spark, store, data_name, version).startswith(_WRITTEN):
        return read_shards(spark, store, split, widen_to, data_name)
    rows = read_split_by_manifest(spark, store, manifest_of(spark, store, data_name, version), split, widen_to)
    return rows.where(F.col("data_name") == F.lit(data_name))


def unreferenced(spark: SparkSession, store: str, data_name: str) -> list[str]:
    """Manifests that no version names: what stopped jobs have left."""
    _, path, fs = _file_system(spark, _top(store, data_name, "manifests"))
    there = {s.getPath().getName() for s in fs.listStatus(path)} if fs.exists(path) else set()
    named = {_named(spark, store, data_name, number) for number in versions(spark, store, data_name)}
    return sorted(there - named)
