"""Streaming: incremental packing equals batch packing (with a restart from
the checkpoint and a replayed batch); live step loss equals batch step loss
(with a restart)."""

import math
import time

import pytest
from pyspark.sql import functions as F

from shardloom.config import PackSpec, TelemetrySpec
from shardloom.operators.packing import doc_offsets, pack_fragments, shard_manifest
from shardloom.operators.telemetry import step_loss
from shardloom.operators.tokenize import ByteTokenizer
from shardloom.sources.telemetry import telemetry_from_events
from shardloom.streaming.packing import (ledger_path, pack_batch, read_packed, read_stream_manifest,
                                         start_incremental_packing)
from shardloom.streaming.telemetry import completed_steps, open_steps, start_live_step_loss

from conftest import SF_SMALL


def _write_parts(df, col, cuts, src):
    bounds = [None] + cuts + [None]
    for i in range(len(bounds) - 1):
        part = df
        if bounds[i] is not None:
            part = part.where(F.col(col) >= bounds[i])
        if bounds[i + 1] is not None:
            part = part.where(F.col(col) < bounds[i + 1])
        part.coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)


def _frag_set(df):
    return sorted((r.shard_id, r.pos, r.doc_ord, tuple(r.tokens)) for r in df.collect())


def test_incremental_packing_equals_batch(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(
        F.lit(0).cast("int").alias("source_ord"), F.col("doc_id").alias("doc_ord"), "text")
    spec = PackSpec("s", shard_tokens=7000, ranges=16)
    tok = ByteTokenizer(spark)
    src, out, ck = f"{tmp_dir}/src", f"{tmp_dir}/out", f"{tmp_dir}/ck"
    _write_parts(docs.where("doc_ord < 100"), "doc_ord", [50], src)
    stream = (spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(src))
    start_incremental_packing(stream, out, ck, tok, spec).awaitTermination()
    # more documents arrive; the query restarts from its checkpoint
    _write_parts(docs.where("doc_ord >= 100"), "doc_ord", [150, 175], src)
    start_incremental_packing(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(src),
                              out, ck, tok, spec).awaitTermination()
    streamed = read_packed(spark, out)
    # arrival order: [0,50) [50,100) [100,150) [150,175) [175,...)
    batch = pack_fragments(docs, tok, spec)
    assert _frag_set(streamed) == _frag_set(batch)
    # a replayed batch (crash after the data write, before the ledger write) changes nothing
    first = docs.where("doc_ord < 50")
    pack_batch(first, 0, out, tok, spec)
    assert _frag_set(read_packed(spark, out)) == _frag_set(batch)


def test_live_step_loss_equals_batch(spark, tmp_dir):
    spec = TelemetrySpec(A=4, W=2)
    tel = telemetry_from_events(spark.read.parquet(f"{SF_SMALL}/events.parquet"), spec)
    tel = tel.withColumn("ts", F.col("ts").cast("timestamp"))
    src, out, ck = f"{tmp_dir}/tsrc", f"{tmp_dir}/tout", f"{tmp_dir}/tck"
    ts_sorted = sorted(r.ts for r in tel.select("ts").collect())
    cuts = [ts_sorted[len(ts_sorted) // 3], ts_sorted[2 * len(ts_sorted) // 3]]
    _write_parts(tel.where(F.col("ts") < cuts[1]), "ts", [cuts[0]], src)
    rd = lambda: spark.readStream.schema(tel.schema).option("maxFilesPerTrigger", 1).parquet(src)
    start_live_step_loss(rd(), out, ck, spec).awaitTermination()
    _write_parts(tel.where(F.col("ts") >= cuts[1]), "ts", [], src)
    start_live_step_loss(rd(), out, ck, spec).awaitTermination()
    live = {(r.run, r.step): r.loss for r in completed_steps(spark, out, spec).collect()}
    want = {(r.run, r.step): r.loss for r in step_loss(tel, spec).collect()}
    assert set(live) == set(want) and open_steps(spark, out, spec).count() == 0
    for k, v in live.items():
        assert math.isclose(v, want[k], rel_tol=1e-9)


def test_live_step_loss_counts_records_and_reports_open_steps(spark, tmp_dir):
    """A record sent twice does not close a step, a missing one leaves it open."""
    spec = TelemetrySpec(A=2, W=2)
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    rows = [("r", 0, m, k, 1.0 + m, at(m)) for m in range(2) for k in range(2)]
    rows += [("r", 1, 0, 0, 5.0, at(10)), ("r", 1, 0, 0, 5.0, at(10)), ("r", 1, 1, 0, 5.0, at(11)), ("r", 1, 1, 1, 5.0, at(12))]
    rec = spark.createDataFrame(rows, "run string, step long, micro_step long, rank long, loss double, ts string")
    rec = rec.withColumn("ts", F.col("ts").cast("timestamp"))
    src, out, ck = f"{tmp_dir}/dsrc", f"{tmp_dir}/dout", f"{tmp_dir}/dck"
    _write_parts(rec, "step", [1], src)
    start_live_step_loss(spark.readStream.schema(rec.schema).option("maxFilesPerTrigger", 1).parquet(src), out, ck,
                         spec).awaitTermination()
    assert [(r.step, r.loss) for r in completed_steps(spark, out, spec).collect()] == [(0, 1.5)]
    assert [(r.step, r.n_records) for r in open_steps(spark, out, spec).collect()] == [(1, 3)]


def test_live_step_loss_of_runs_of_unequal_length_loses_no_late_record(spark, tmp_dir):
    """A long run's old steps come in a later file than a short run's newest: days behind any watermark, they count, once."""
    spec = TelemetrySpec(A=2, W=2)
    row = lambda run, s, t, m, k: (run, s, m, k, 1.0 + s, f"2024-01-{t:02d} 0{m}:00:0{k}")
    steps = [("short", s, 20 + s) for s in range(3)] + [("long", s, 1 + s) for s in range(12)]
    rows = [row(*x, m, k) for x in steps for m in range(2) for k in range(2)]
    again = [row("long", 0, 1, 0, 0), row("long", 11, 12, 1, 1)]
    rec = spark.createDataFrame(rows + again, "run string, step long, micro_step long, rank long, loss double, ts string")
    rec = rec.withColumn("ts", F.col("ts").cast("timestamp"))
    src, out, ck = f"{tmp_dir}/lsrc", f"{tmp_dir}/lout", f"{tmp_dir}/lck"
    _write_parts(rec, "step", [3, 6, 9], src)
    _write_parts(rec.where("run = 'long' AND step = 0"), "step", [], src)
    start_live_step_loss(spark.readStream.schema(rec.schema).option("maxFilesPerTrigger", 1).parquet(src), out, ck,
                         spec).awaitTermination()
    got = {(r.run, r.step): r.loss for r in completed_steps(spark, out, spec).collect()}
    assert got == {(run, s): 1.0 + s for run, s, _ in steps} and open_steps(spark, out, spec).count() == 0


def test_unreadable_ledger_is_no_new_start(spark, tmp_dir):
    import os

    out = f"{tmp_dir}/broken"
    os.makedirs(f"{ledger_path(out)}/batch_id=0")
    with open(f"{ledger_path(out)}/batch_id=0/part-0.parquet", "w") as f:
        f.write("not parquet")
    docs = spark.createDataFrame([(0, 1, "a b")], "source_ord int, doc_ord long, text string")
    with pytest.raises(Exception):
        pack_batch(docs, 1, out, ByteTokenizer(spark), PackSpec("s", shard_tokens=10))


def test_stream_manifest_equals_batch(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(
        F.lit(0).cast("int").alias("source_ord"), F.col("doc_id").alias("doc_ord"), "text")
    spec, tok = PackSpec("s", shard_tokens=7000), ByteTokenizer(spark)
    src, out, ck = f"{tmp_dir}/msrc", f"{tmp_dir}/mout", f"{tmp_dir}/mck"
    _write_parts(docs, "doc_ord", [60, 120], src)
    start_incremental_packing(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(src), out, ck,
                              tok, spec).awaitTermination()
    got = read_stream_manifest(spark, out, spec)
    want = shard_manifest(doc_offsets(docs, tok, spec), spec).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_arriving_parts_keep_order_in_several_files_and_null_keys(spark, tmp_dir):
    from shardloom.plans import queries as Q

    rows = spark.createDataFrame([(0, k if k < 100 else None, f"text {k}") for k in range(101)], "source_ord int, doc_ord long, text string")
    rows.write.parquet(f"{tmp_dir}/rows")
    rows = spark.read.parquet(f"{tmp_dir}/rows")
    for size, files in ((1 << 40, 1), (1, 4)):
        seen = []
        stream = Q._arriving(spark, rows, "doc_ord", f"arriving-{files}", file_bytes=size)
        read = lambda batch, _: seen.append((batch.select(F.input_file_name()).distinct().count(), [r.doc_ord for r in batch.collect()]))
        stream.writeStream.foreachBatch(read).option("checkpointLocation", f"{tmp_dir}/a{files}").trigger(availableNow=True).start().awaitTermination()
        assert [n for n, _ in seen] == [files] * Q.STREAM_BATCHES
        assert None in seen[0][1] and sum(len(x) for _, x in seen) == 101
        keys = [[k for k in x if k is not None] for _, x in seen]
        assert all(max(a) < min(b) for a, b in zip(keys, keys[1:]))


def test_null_order_key_fails_the_stream_as_it_fails_the_batch(spark, tmp_dir):
    from shardloom.plans import queries as Q

    docs = spark.createDataFrame([(0, 1, "a b"), (0, None, "c d"), (0, 2, "e f")], "source_ord int, doc_ord long, text string")
    stream = Q._arriving(spark, docs, "doc_ord", "null-docs")
    with pytest.raises(Exception, match="null order key"):
        start_incremental_packing(stream, f"{tmp_dir}/no", f"{tmp_dir}/nock", ByteTokenizer(spark), PackSpec("s", shard_tokens=10)).awaitTermination()


def test_a_part_of_some_megabytes_is_read_by_several_tasks(spark, tmp_dir, monkeypatch):
    from shardloom.plans import queries as Q

    monkeypatch.setattr(Q, "staging_path", lambda *_: f"{tmp_dir}/parts")
    rows = spark.range(0, 4_000_000, 1, 4).selectExpr("id AS doc_ord", "0 AS source_ord")
    Q._arriving(spark, rows, "doc_ord", "parts")
    assert Q._parquet_files(spark, f"{tmp_dir}/parts") >= 2 * Q.STREAM_BATCHES
    assert spark.read.parquet(f"{tmp_dir}/parts").count() == 4_000_000
