"""Rank dealing and the step schedule against a cursor simulation of the
reference loader (its per-rank mutable position, shard switch and wrap)."""

import random

import pytest

from shardloom.config import WindowSpec, accumulation_steps
from shardloom.operators.batches import batch_schedule, rank_batches, short_shards


def cursor(lengths, B, T, N, W, r, count):
    """The reference loader's sequence of (shard index, position) for rank r."""
    shard, pos, out = 0, B * T * r, []
    for _ in range(count):
        out.append((shard, pos))
        pos += B * T * W
        if pos + (B * T * W + N) > lengths[shard]:
            shard = (shard + 1) % len(lengths)
            pos = B * T * r
    return out


def manifest(spark, lengths):
    return spark.createDataFrame(list(enumerate(lengths)), "shard_id long, n_tokens long")


@pytest.mark.parametrize("seed", range(4))
def test_schedule_matches_cursor(spark, seed):
    rng = random.Random(seed)
    B, T, N, W = rng.choice([1, 2]), rng.choice([2, 4]), rng.choice([1, 3]), rng.choice([1, 2, 4])
    A, steps = rng.choice([1, 2, 3]), rng.randint(5, 40)
    lengths = [rng.randint(B * T * W + N, 120) for _ in range(rng.randint(1, 5))]
    spec = WindowSpec(B=B, T=T, N=N, W=W)
    rows = batch_schedule(manifest(spark, lengths), spec, A, steps).collect()
    got = {}
    for r in rows:
        got[(r.rank, r.step * A + r.micro_step)] = (r.shard_id, r.pos)
    for rank in range(W):
        want = cursor(lengths, B, T, N, W, rank, steps * A)
        assert [got[(rank, m)] for m in range(steps * A)] == want


def test_resume_continues_schedule(spark):
    spec = WindowSpec(B=1, T=4, N=1, W=2)
    m = manifest(spark, [30, 50, 17])
    full = {(r.step, r.micro_step, r.rank): (r.shard_id, r.pos) for r in batch_schedule(m, spec, 2, 30).collect()}
    tail = {(r.step, r.micro_step, r.rank): (r.shard_id, r.pos) for r in batch_schedule(m, spec, 2, 30, 12).collect()}
    assert tail == {k: v for k, v in full.items() if k[0] >= 12}


def test_rank_desync_example(spark):
    # L = 10 batches + N with W = 4 -> batches per rank 2, 2, 2, 1 (quirk Q8)
    B, T, N, W = 2, 4, 1, 4
    L = 10 * B * T + N
    rows = rank_batches(manifest(spark, [L]), WindowSpec(B=B, T=T, N=N, W=W)).collect()
    per = {}
    for r in rows:
        per[r.rank] = per.get(r.rank, 0) + 1
    assert per == {0: 2, 1: 2, 2: 2, 3: 1}


def test_short_shard_reported(spark):
    spec = WindowSpec(B=2, T=4, N=1, W=2)
    m = manifest(spark, [100, 9, 12])
    short = {(r.shard_id, r.rank) for r in short_shards(m, spec).collect()}
    # rank 0 needs B*T + N = 9 tokens, rank 1 needs 17
    assert short == {(1, 1), (2, 1)}


def test_accumulation_steps():
    assert accumulation_steps(524288, WindowSpec(B=8, T=256, N=1, W=1)) == 256
    with pytest.raises(ValueError):
        accumulation_steps(1000, WindowSpec(B=8, T=256, N=1, W=1))


def test_aligned_ranks_take_the_minimum(spark):
    B, T, N, W = 2, 4, 1, 4
    L = 10 * B * T + N
    rows = rank_batches(manifest(spark, [L, 200]), WindowSpec(B=B, T=T, N=N, W=W), aligned=True).collect()
    per = {}
    for r in rows:
        per[(r.shard_id, r.rank)] = per.get((r.shard_id, r.rank), 0) + 1
    assert {v for (s, _), v in per.items() if s == 0} == {1}
    assert len({v for (s, _), v in per.items() if s == 1}) == 1


@pytest.mark.parametrize("W", [1, 2, 3, 4])
def test_ranks_partition_the_batches(spark, W):
    B, T, N = 2, 4, 1
    lengths = [37, 64, 100, 9 + B * T * W]
    rows = rank_batches(manifest(spark, lengths), WindowSpec(B=B, T=T, N=N, W=W)).collect()
    seen = {}
    for r in rows:
        assert (r.shard_id, r.batch) not in seen          # no batch dealt twice
        seen[(r.shard_id, r.batch)] = r.rank
        assert r.batch % W == r.rank
        assert r.pos + B * T + N <= lengths[r.shard_id]   # every dealt batch fits its shard


from hypothesis import given, settings, strategies as st  # noqa: E402


@settings(max_examples=12, deadline=None)
@given(B=st.integers(1, 3), T=st.integers(1, 5), N=st.integers(1, 6), W=st.integers(1, 4), A=st.integers(1, 3),
       steps=st.integers(1, 25), extra=st.lists(st.integers(0, 80), min_size=1, max_size=5))
def test_schedule_matches_cursor_property(spark, B, T, N, W, A, steps, extra):
    lengths = [B * T * W + N + e for e in extra]        # every rank's first batch fits
    rows = batch_schedule(manifest(spark, lengths), WindowSpec(B=B, T=T, N=N, W=W), A, steps).collect()
    got = {(r.rank, r.step * A + r.micro_step): (r.shard_id, r.pos) for r in rows}
    assert len(got) == len(rows) == W * steps * A
    for rank in range(W):
        assert [got[(rank, m)] for m in range(steps * A)] == cursor(lengths, B, T, N, W, rank, steps * A)


def test_whole_test_loss_reads_every_dealt_batch(spark):
    """Also where the testing split is longer than the fixed number of test steps."""
    from pyspark.sql import functions as F

    from conftest import SF_MID
    from shardloom.operators.batches import rank_batches
    from shardloom.plans import queries as Q

    steps = Q.whole_test_steps(spark, SF_MID)
    key = ["rank", "shard_id", "batch"]
    got = Q.test_losses(spark, SF_MID, steps)
    want = rank_batches(Q.test_manifest(spark, SF_MID), Q.LM_LOADER)
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    assert steps > Q.TEST_STEPS and got.agg(F.max("n_reads")).first()[0] == 2
    assert {r["n"] for r in got.groupBy("rank").agg(F.sum("n_reads").alias("n")).collect()} == {steps}
