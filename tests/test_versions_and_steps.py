"""Versioned manifests, the documents that steps read, and generation by joins, against plain versions."""

import glob
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.config import PackSpec, SplitRatio, WindowSpec
from shardloom.operators import batches as BA
from shardloom.operators import ngram as NG
from shardloom.operators import packing as PK
from shardloom.operators import stepwise as SW
from shardloom.operators.generate import draw_u32, pick_candidate
from shardloom.operators.readback import step_documents
from shardloom.operators.tokenize import ByteTokenizer
from shardloom.sources import store as ST


@pytest.fixture()
def packed(spark):
    docs = spark.createDataFrame([(0, i, "x" * (17 * i % 90)) for i in range(60)], "source_ord int, doc_ord long, text string")
    spec, tok = PackSpec("s", shard_tokens=100), ByteTokenizer(spark)
    offsets = PK.doc_offsets(docs, tok, spec)
    return PK.label_splits(PK.pack_fragments(docs, tok, spec)), PK.shard_manifest(offsets, spec), PK.fragment_spans(offsets, 100)


def _files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data_name=*/**/*.parquet", recursive=True)}


def _held(spark, path, version=None):
    return {s: sorted({r.shard_id for r in ST.read_split(spark, path, "s", s, version).collect()}) for s in ("training", "validation", "testing")}


def _want(n, ratio):
    cuts = (ratio.training, ratio.training + ratio.validation)
    label = lambda i: "training" if i % 10 < cuts[0] else "validation" if i % 10 < cuts[1] else "testing"
    return {s: [i for i in range(n) if label(i) == s] for s in ("training", "validation", "testing")}


def test_resplit_writes_no_token_and_readers_may_stay(spark, tmp_dir, packed):
    fragments, manifest, _ = packed
    n = manifest.count()
    assert ST.create(fragments, manifest, tmp_dir, "s") == 1
    before = _files(tmp_dir)
    assert _held(spark, tmp_dir) == _want(n, SplitRatio())
    assert ST.resplit(spark, tmp_dir, "s", SplitRatio(5, 3, 2)) == 2
    assert ST.resplit(spark, tmp_dir, "s", SplitRatio(2, 2, 6)) == 3
    assert _files(tmp_dir) == before
    assert _held(spark, tmp_dir) == _want(n, SplitRatio(2, 2, 6))
    assert _held(spark, tmp_dir, 2) == _want(n, SplitRatio(5, 3, 2)) and _held(spark, tmp_dir, 1) == _want(n, SplitRatio())
    total = lambda v: sum(len(r.tokens) for s in _held(spark, tmp_dir) for r in ST.read_split(spark, tmp_dir, "s", s, v).collect())
    assert total(1) == total(3) == manifest.agg(F.sum("n_tokens")).first()[0]
    with pytest.raises(ValueError, match="no version"):
        ST.manifest_of(spark, tmp_dir, "s", 9)
    few = manifest.where("shard_id < 3")
    ST.create(fragments.where("shard_id < 3"), few, f"{tmp_dir}/few", "s")
    with pytest.raises(ValueError, match="no shards for split"):
        ST.resplit(spark, f"{tmp_dir}/few", "s", SplitRatio(5, 3, 2))
    assert ST.versions(spark, f"{tmp_dir}/few", "s") == [1]


def test_a_job_that_stops_before_it_publishes_changes_nothing(spark, tmp_dir, packed, monkeypatch):
    fragments, manifest, _ = packed
    ST.create(fragments, manifest, tmp_dir, "s")
    held = _held(spark, tmp_dir)

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(ST, "_publish", stop)
        with pytest.raises(RuntimeError, match="stopped"):
            ST.resplit(spark, tmp_dir, "s", SplitRatio(5, 3, 2))
    assert ST.versions(spark, tmp_dir, "s") == [1] and _held(spark, tmp_dir) == held
    assert len(ST.unreferenced(spark, tmp_dir, "s")) == 1
    assert ST.resplit(spark, tmp_dir, "s", SplitRatio(5, 3, 2)) == 2 and len(ST.unreferenced(spark, tmp_dir, "s")) == 1


def test_two_writers_get_two_versions(spark, tmp_dir, packed, monkeypatch):
    fragments, manifest, _ = packed
    ST.create(fragments, manifest, tmp_dir, "s")
    other = ST.resplit(spark, tmp_dir, "s", SplitRatio(5, 3, 2))
    # a writer that listed the versions before the other one published
    monkeypatch.setattr(ST, "versions", lambda *a, seen=[[1]], real=ST.versions: seen.pop() if seen else real(*a))
    assert ST._publish(spark, tmp_dir, "s", ST._stage_manifest(spark, ST.resplit_manifest(manifest, SplitRatio(6, 2, 2)), tmp_dir, "s")) == other + 1
    assert _held(spark, tmp_dir, other)["testing"] == _want(manifest.count(), SplitRatio(5, 3, 2))["testing"]


@pytest.mark.parametrize("bin_tokens", [0, 1, 7, 1000])
def test_step_documents_by_token(spark, packed, bin_tokens):
    fragments, manifest, spans = packed
    spec = WindowSpec(B=2, T=8, N=3, W=2)
    train = manifest.where("split = 'training'")
    schedule = BA.batch_schedule(train, spec, 2, 40)
    owner = {(r.shard_id, r.pos + k): r.doc_ord for r in fragments.collect() for k in range(len(r.tokens))}
    read, held = Counter(), Counter()
    for r in schedule.collect():
        for p in range(r.pos, r.pos + 19):
            if (doc := owner.get((r.shard_id, p))) is not None:
                read[r.step, r.rank, doc] += 1
                held[r.step, r.rank, doc] += p < r.pos + 16
    got = step_documents(schedule, spans, spec, bin_tokens).collect()
    assert {(r.step, r.rank, r.doc_ord): (r.n_read, r.n_tokens) for r in got} == {k: (n, held[k]) for k, n in read.items()}
    assert sum(r.n_tokens for r in got) == 40 * 2 * 2 * 16


@pytest.mark.parametrize("order", [2, 3])
def test_generation_by_joins_equals_plain(spark, order):
    rng = np.random.default_rng(order)
    train = [(w[:-1], w[1:]) for w in (np.minimum(rng.zipf(1.5, 12), 9).tolist() for _ in range(40))]
    counts = NG.target_counts(spark.createDataFrame(train, "x array<int>, y array<int>").repartition(3), order)
    follow = defaultdict(Counter)
    for x, y in train:
        for j, b in enumerate(y):
            for n in range(min(order - 1, j + 1) + 1):
                follow[tuple(x[j + 1 - n : j + 1])][b] += 1
    top = {c: sorted(f.items(), key=lambda t: (-t[1], t[0]))[:5] for c, f in follow.items()}
    prompts = [("r", 1, [1, 2]), ("r", 2, [77]), ("s", 2, []), ("s", 3, [3] * 15), ("s", 4, [5, 88, 1])]
    want = {}
    for run, item, tokens in prompts:
        seq = list(tokens)
        while len(seq) < 12:
            found = next(top[tuple(seq[len(seq) - n :])] for n in range(min(order - 1, len(seq)), -1, -1) if tuple(seq[len(seq) - n :]) in top)
            seq.append(pick_candidate(draw_u32(42, run, item, len(seq)), *zip(*found)))
        want[run, item] = seq[:12]
    model = SW.successors(counts, order)
    df = spark.createDataFrame(prompts, "run string, item_id long, tokens array<int>").repartition(2)
    got = SW.generate_by_joins(df, model, order, 12).collect()
    assert {(r.run, r.item_id): r.tokens for r in got} == want and len(got) == 5
    none = spark.createDataFrame([], "run string, item_id long, tokens array<int>")
    assert SW.generate_by_joins(none, model, order, 12).count() == 0
    with pytest.raises(ValueError, match="no token"):
        SW.generate_by_joins(df, model.where("n > 0"), order, 12)


def test_a_step_shuffles_prompts_and_not_the_model(spark, tmp_dir):
    spark.createDataFrame([("r", i, [i, i + 1]) for i in range(20)], "run string, item_id long, tokens array<int>").coalesce(1).write.parquet(f"{tmp_dir}/prompts")
    model = spark.range(50_000).selectExpr("int(id % 3) AS n", "if(id % 3 = 0, '', concat_ws(' ', id, if(id % 3 = 2, id + 1, null))) AS context", "array(int(id % 7)) AS bs", "array(1L) AS cs")
    model.where("n > 0 OR context = ''").coalesce(1).write.parquet(f"{tmp_dir}/model")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # prompts are below, the model is above
    try:
        stepped = SW._step(spark.read.parquet(f"{tmp_dir}/prompts"), spark.read.parquet(f"{tmp_dir}/model"), 3, 42)
        plan = stepped._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"BroadcastHashJoin [^\n]* Inner, BuildRight", plan)) == 3
