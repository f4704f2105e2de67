"""Top-k in bounded space and pixel-exact curves against plain versions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from shardloom.operators import countmodel as CM
from shardloom.operators import heavyhitters as HH
from shardloom.operators import scoring as SC
from shardloom.operators import telemetry as TM

from conftest import SF_MID

SEQS = "split string, shard_id long, seq long, x array<int>, y array<int>"


def sequences_of(spark, pairs, T=16, parts=3):
    pairs = pairs[: len(pairs) // T * T]
    rows = [("training", 0, i, [a for a, _ in pairs[i * T:(i + 1) * T]], [b for _, b in pairs[i * T:(i + 1) * T]])
            for i in range(len(pairs) // T)]
    return spark.createDataFrame(rows, SEQS).repartition(parts), pairs


def plain_topk(pairs, k):
    by = defaultdict(Counter)
    for a, b in pairs:
        by[a][b] += 1
    return sorted((a, r, b, c) for a, cs in by.items()
                  for r, (b, c) in enumerate(sorted(cs.items(), key=lambda bc: (-bc[1], bc[0]))[:k], 1))


def mixed_pairs(seed=3):
    rng = random.Random(seed)
    pairs = [(1, b) for b in (7, 7, 7, 8, 8, 9)] * 20                                  # few successors: no error
    pairs += [(2, rng.choice([1, 2, 3] * 60 + list(range(100, 400)))) for _ in range(6000)]   # a clear top in a long tail
    pairs += [(3, rng.randrange(60000)) for _ in range(3000)]                          # flat: no proof
    pairs += [(65535, b) for b in range(40)] * 3                                       # ties everywhere
    rng.shuffle(pairs)
    return pairs


def test_all_three_ways_give_the_top_k(spark):
    seqs, pairs = sequences_of(spark, mixed_pairs())
    size, k = 8, 3
    state = {r.a: r.state for r in HH.proofs(HH.summaries(seqs, size), k, size).collect()}
    assert state == {1: "exact", 2: "proven", 3: "open", 65535: "open"}
    got = sorted(tuple(r) for r in HH.topk_bounded(seqs, k, size).select("a", "rnk", "b", "c").collect())
    assert got == plain_topk(pairs, k)
    whole = sorted(tuple(r) for r in CM.topk_next(CM.next_token_counts(seqs), k).collect())
    assert got == whole


def test_summary_bounds_hold_in_bounded_space():
    rng, size = np.random.default_rng(1), 6
    held, true = HH.Summary(size), Counter()
    for _ in range(40):
        a, b = rng.integers(0, 5, 500), np.minimum(rng.zipf(1.4, 500), 65535)
        held.add(a, b)
        true.update(zip(a.tolist(), b.tolist()))
        assert np.bincount(held.key >> 16).max() <= size
    low = {(int(x) >> 16, int(x) & 0xFFFF): int(c) for x, c in zip(held.key, held.count)}
    for (a, b), n in true.items():
        assert low.get((a, b), 0) <= n <= low.get((a, b), 0) + held.err[a]


def test_ids_outside_the_range_and_empty_input(spark):
    with pytest.raises(ValueError):
        HH.Summary().add(np.array([1]), np.array([65536]))
    empty = spark.createDataFrame([], SEQS)
    assert HH.topk_bounded(empty).collect() == []
    with pytest.raises(ValueError):
        HH.topk_bounded(empty, k=9, size=8)


def pixels(points, lo, span, width, height, bottom, top):
    """Pixels that a line through the points covers, drawn column by column and step by step."""
    at = [((s - lo) * width // span, int((np.log10(v) - bottom) / (top - bottom) * (height - 1))) for s, v in sorted(points)]
    out = set(at)
    for (x0, y0), (x1, y1) in zip(at, at[1:]):
        n = max(abs(x1 - x0), abs(y1 - y0))
        out.update((x0 + round(i * (x1 - x0) / n), y0 + round(i * (y1 - y0) / n)) for i in range(n))
    return out


def test_reduced_curves_draw_the_same_picture(spark):
    rng = random.Random(5)
    runs = {f"r{k}": [(s, 8 / (1 + s / 90) + rng.random() ** 3 * 3) for s in range(k * 100, 2500 - k * 400, 1 + k)] for k in range(3)}
    rows = [(r, s, v) for r, ps in runs.items() for s, v in ps]
    bad = [("r0", 5000, float("nan")), ("r0", 5001, float("inf")), ("r1", 5002, 0.0), ("r1", 5003, -1.0), ("r2", 5004, None), (None, 7, 2.0)]
    df = spark.createDataFrame(rows + bad, "run string, step long, loss double").repartition(5)
    width = 50
    got = defaultdict(list)
    for r in TM.curve_pixels(df, width).collect():
        assert r.px == r.step * width // 2500
        got[r.run].append((r.step, r.loss))
    assert got.pop(None) == [(7, 2.0)]
    for run, points in runs.items():
        assert len(got[run]) <= 4 * width < len(points) or run != "r0"
        assert set(got[run]) <= set(points)
        args = (0, 2500, width, 40, -1.0, 1.2)
        assert pixels(got[run], *args) == pixels(points, *args)


def test_curves_of_nothing_and_of_one_point(spark):
    schema = "run string, step long, loss double"
    assert TM.curve_pixels(spark.createDataFrame([], schema), 10).collect() == []
    assert [tuple(r) for r in TM.curve_pixels(spark.createDataFrame([("a", 3, 1.5)] * 2, schema), 10).collect()] == [("a", 0, 3, 1.5)]
    with pytest.raises(ValueError):
        TM.curve_pixels(spark.createDataFrame([], schema), 0)


def test_rank_losses_are_the_sums_of_batch_losses(spark):
    from shardloom.plans import queries as Q

    sf, steps = SF_MID, 25
    args = (Q.seqs(spark, sf, Q.LM_N).where("split = 'testing'"), Q.test_manifest(spark, sf), Q.lm_counts(spark, sf), Q.LM_LOADER,
            Q.word_tokenizer(spark, sf).vocab_size, steps)
    [whole] = TM.test_loss(SC.test_batch_losses(*args), steps).collect()
    ranks = {r["rank"]: r["loss"] for r in SC.test_rank_losses(*args).collect()}
    assert len(ranks) == Q.LM_LOADER.W
    assert math.isclose(sum(ranks.values()) / len(ranks), whole.test_loss, rel_tol=1e-12)
