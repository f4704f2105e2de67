"""Plan-shape checks (pushdown, pruning, no single-task window over row-level
data, partial top-k) and skew checks (a hot group spreads over tasks)."""

import io
import contextlib

from pyspark.sql import functions as F

from shardloom.config import PackSpec
from shardloom.operators.countmodel import topk_next
from shardloom.operators.packing import doc_offsets
from shardloom.operators.tokenize import ByteTokenizer
from shardloom.plans import queries as Q
from shardloom.plans.ordering import row_index
from shardloom.session import stage_table

from conftest import SF_SMALL


def plan_of(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_filter_and_projection_reach_the_scan(spark):
    p = plan_of(Q.q_corpus_scan(spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in p
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in p


def test_split_read_prunes_partitions(spark, tmp_dir):
    from shardloom.sources.shards import read_shards, write_shards
    frags = Q.fragments(spark, SF_SMALL)
    write_shards(frags, Q.manifest(spark, SF_SMALL), f"{tmp_dir}/s", Q.DATA_NAME)
    p = plan_of(read_shards(spark, f"{tmp_dir}/s", "training").select("pos"))
    assert "PartitionFilters: [isnotnull(split" in p and "= training)]" in p
    assert "ReadSchema: struct<pos:bigint>" in p


def test_offsets_have_no_single_partition_window_over_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(
        F.lit(0).alias("source_ord"), F.col("doc_id").alias("doc_ord"), "text")
    p = plan_of(doc_offsets(docs, ByteTokenizer(spark), PackSpec("p", 1000, ranges=16)), "simple")
    # the document-level window is partitioned by its range
    assert "windowspecdefinition(_range" in p or "windowspecdefinition(0, _range" in p
    # the one un-partitioned window runs over range totals, read from a staged table
    singles = [ln for ln in p.splitlines() if "SinglePartition" in ln]
    assert len(singles) <= 1


def test_topk_uses_partial_group_limit(spark):
    counts = spark.createDataFrame([(a % 7, b, (a * b) % 5 + 1) for a in range(50) for b in range(30)],
                                   "a int, b int, c long")
    p = plan_of(topk_next(counts, 5), "simple")
    assert "WindowGroupLimit" in p


def test_hot_group_spreads_over_tasks(spark):
    # one run holds ~90% of rows; the range repartition splits it over partitions
    rows = [("hot" if i % 10 else f"r{i % 3}", i, i // 2) for i in range(4000)]
    df = spark.createDataFrame(rows, "run string, id long, ts long")
    ranged = (df.repartitionByRange(8, "run", "ts", "id").withColumn("_pid", F.spark_partition_id()))
    pids = {r._pid for r in stage_table(ranged, "t").where("run = 'hot'").select("_pid").distinct().collect()}
    assert len(pids) >= 4
    idx = row_index(df, ["run"], ["ts", "id"]).collect()
    by_run = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        by_run.setdefault(r[0], []).append(r[1])
    want = {(run, rid): i for run, ids in by_run.items() for i, rid in enumerate(ids)}
    assert {(r.run, r.id): r.i for r in idx} == want


def test_drop_staged_tables(spark):
    from shardloom.session import drop_staged_tables, staging_path
    df = stage_table(spark.range(10), "t")
    assert df.count() == 10
    assert drop_staged_tables(spark)
    p = staging_path(spark, "x")
    assert "shardloom-tables" in p


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    import pytest

    from shardloom.session import ensure_checkpoint_dir

    class Sc:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Sc()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_shards_are_one_file_each(spark, tmp_dir):
    import glob

    from shardloom.plans import queries as Q
    from shardloom.sources.shards import write_shards
    man = Q.manifest(spark, SF_SMALL)
    write_shards(Q.fragments(spark, SF_SMALL), man, f"{tmp_dir}/one", Q.DATA_NAME)
    files = glob.glob(f"{tmp_dir}/one/data_name=*/split=*/shard_id=*/*.parquet")
    assert len(files) == man.count()
