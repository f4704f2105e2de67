"""Sequences, target pairs and the (B, T) view against flat-list slicing."""

import random

import pytest

from shardloom.operators.windows import batch_rows, sequences, target_pairs
from shardloom.config import WindowSpec


def shard_frags(spark, shards, rng, max_frag=9):
    rows = []
    for sid, toks in shards.items():
        pos = 0
        while pos < len(toks):
            m = rng.randint(1, max_frag)
            rows.append((sid, pos, toks[pos:pos + m]))
            pos += m
    return spark.createDataFrame(rows, "shard_id long, pos long, tokens array<int>").repartition(3)


@pytest.mark.parametrize("T,N", [(4, 1), (5, 2), (3, 7), (1, 1), (8, 8)])
def test_sequences_equal_flat_windows(spark, T, N):
    rng = random.Random(T * 31 + N)
    shards = {s: [rng.randint(0, 99) for _ in range(rng.randint(0, 60))] for s in range(4)}
    got = {(r.shard_id, r.seq): (list(r.x), list(r.y))
           for r in sequences(shard_frags(spark, shards, rng), T, N).collect()}
    want = {}
    for sid, toks in shards.items():
        seq = 0
        while seq * T + T + N <= len(toks):
            s0 = seq * T
            want[(sid, seq)] = (toks[s0:s0 + T], toks[s0 + N:s0 + N + T])
            seq += 1
    assert got == want
    pairs = target_pairs(sequences(shard_frags(spark, shards, rng), T, N), T).collect()
    for r in pairs:
        assert shards[r.shard_id][r.pos] == r.a and shards[r.shard_id][r.pos + N] == r.b
    assert len(pairs) == T * len(want)


def test_batch_view(spark):
    df = spark.createDataFrame([(s,) for s in range(7)], "seq long")
    rows = batch_rows(df, WindowSpec(B=3, T=4, N=1, W=1)).orderBy("seq").collect()
    assert [(r.batch, r.row) for r in rows] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0)]


@pytest.mark.parametrize("T,N,max_frag", [(3, 5, 40), (4, 1, 60), (2, 9, 25), (6, 6, 13)])
def test_long_fragments_mix_whole_and_crossing(spark, T, N, max_frag):
    rng = random.Random(T * 7 + N * 3 + max_frag)
    shards = {s: [rng.randint(0, 9) for _ in range(rng.randint(20, 150))] for s in range(3)}
    got = {(r.shard_id, r.seq): (list(r.x), list(r.y))
           for r in sequences(shard_frags(spark, shards, rng, max_frag), T, N).collect()}
    want = {}
    for sid, toks in shards.items():
        seq = 0
        while seq * T + T + N <= len(toks):
            s0 = seq * T
            want[(sid, seq)] = (toks[s0:s0 + T], toks[s0 + N:s0 + N + T])
            seq += 1
    assert got == want


@pytest.mark.parametrize("B,T,N,W", [(2, 4, 1, 2), (1, 3, 5, 3)])
def test_scheduled_fragments_keep_every_scheduled_window(spark, B, T, N, W):
    from shardloom.operators.batches import batch_schedule, schedule_sequences, scheduled_fragments
    rng = random.Random(B * 100 + N)
    shards = {s: [rng.randint(0, 99) for _ in range(rng.randint(B * T * W + N, 200))] for s in range(5)}
    frags = shard_frags(spark, shards, rng, 12)
    man = spark.createDataFrame([(s, len(t)) for s, t in shards.items()], "shard_id long, n_tokens long")
    spec = WindowSpec(B=B, T=T, N=N, W=W)
    sched = batch_schedule(man, spec, 1, 7)
    rows = schedule_sequences(sched, spec).select("step", "rank", "row", "shard_id", "seq")
    full = rows.join(sequences(frags, T, N), ["shard_id", "seq"])
    pruned = rows.join(sequences(scheduled_fragments(frags, sched, spec), T, N), ["shard_id", "seq"])
    key = lambda r: (r.step, r.rank, r.row, r.shard_id, r.seq, tuple(r.x), tuple(r.y))
    a = sorted(map(key, full.collect()))
    assert a == sorted(map(key, pruned.collect()))
    assert len(a) == rows.count()


def test_unfolded_pairs(spark):
    """Every target once, and no silent cut where x and y differ in length."""
    from shardloom.operators.countmodel import unfolded

    schema = "split string, x array<int>, y array<int>"
    got = unfolded(spark.createDataFrame([("a", [1, 2, 2], [2, 2, 3]), ("b", [], []), ("c", [7], [7])], schema), "split")
    assert got.columns == ["split", "a", "b"]
    assert sorted(map(tuple, got.collect())) == [("a", 1, 2), ("a", 2, 2), ("a", 2, 3), ("c", 7, 7)]
    for x, y in (([1, 2], [2]), ([1], [2, 3])):
        with pytest.raises(Exception, match="differ in length"):
            unfolded(spark.createDataFrame([("a", x, y)], schema)).collect()
