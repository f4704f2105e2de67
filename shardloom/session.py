"""Session helpers: building a session for tests / bench and staging tables.

Intermediate tables that several consumers read (tokenised documents, frozen
row indexes) are written as Parquet under the shared folder the cluster names
in ``spark.checkpoint.dir``.  That cuts lineage, survives executor loss and
lets later scans prune columns.  We only choose a folder ourselves when the
session has none (local tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "shardloom") -> SparkSession:
    """Session for tests and the bench; production code receives a session."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.  A session in local mode that
    names none gets one; on a cluster that is an error, since a folder on one
    machine is not seen by the others."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder (master {sc.master})")
        configured = tempfile.mkdtemp(prefix="shardloom-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one staged table under the checkpoint folder, or
    under that of the ``staging_scope`` this thread is in."""
    top = getattr(_SCOPE, "folder", None) or f"{ensure_checkpoint_dir(spark).rstrip('/')}/shardloom-tables"
    return f"{top}/{name}-{uuid.uuid4().hex}"


_SCOPE = threading.local()


@contextmanager
def staging_scope(spark: SparkSession, name: str):
    """What is staged inside is removed at the end, also after an error: for
    work that writes its result itself, as a micro-batch does."""
    outer = getattr(_SCOPE, "folder", None)
    _SCOPE.folder = staging_path(spark, name)
    folder = _SCOPE.folder
    try:
        yield folder
    finally:
        _SCOPE.folder = outer
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> bool:
    """Remove a folder through the Hadoop FileSystem API, whatever its store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    Used where a result feeds several consumers or carries values that must not
    be recomputed (partition ids, monotonically increasing ids).
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``shardloom`` importable on executors (what ``--py-files`` does):
    zip the package once per application and ``addPyFile`` it.  UDFs and
    ``mapInPandas`` functions refer to package helpers by module name."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="shardloom-pyfiles-")
    zpath = os.path.join(out_dir, "shardloom.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in root:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


def drop_staged_tables(spark: SparkSession) -> bool:
    """Delete this application's staged tables (everything ``stage_table`` and
    the prepared-table cache wrote) through the Hadoop FileSystem API, so it
    works for any shared store.  Call once the results are consumed."""
    for forget in _ON_DROP:
        forget(spark.sparkContext.applicationId)
    return _delete(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/shardloom-tables")


#: Called with the application's id when its staged tables are dropped.
_ON_DROP: list = []


def on_drop(forget):
    """Register what has to forget paths of staged tables (a decorator)."""
    _ON_DROP.append(forget)
    return forget
