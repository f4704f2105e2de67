"""Flat shard files, growing log files, bounded live state, and the backoff model against plain versions."""

import io
import math
import os
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardloom.config import TelemetrySpec
from shardloom.operators import ngram as NG
from shardloom.sources import livelogs as LL
from shardloom.sources import npy as NP
from shardloom.sources import telemetry as TS
from shardloom.streaming import telemetry as ST


# -- flat shards ------------------------------------------------------------------

FRAGMENTS = "shard_id long, pos long, tokens array<int>"
MANIFEST = "shard_id long, file_name string, n_tokens long"


def flat(spark, sizes, split="training", name="d", seed=0):
    """Fragments of shards of the given sizes in pieces, their manifest, and the tokens."""
    rng = np.random.default_rng(seed)
    tokens = {k: rng.integers(0, 1 << 16, n).tolist() for k, n in enumerate(sizes)}
    rows = [(k, a, t[a : a + 700]) for k, t in tokens.items() for a in range(0, max(1, len(t)), 700)]
    manifest = [(k, f"{name}_{k:06d}_{split}", len(t)) for k, t in tokens.items()]
    return spark.createDataFrame(rows, FRAGMENTS).repartition(3), spark.createDataFrame(manifest, MANIFEST), tokens


def test_numpy_reads_what_is_written_and_ranges_read_it_back(spark, tmp_dir):
    fragments, manifest, tokens = flat(spark, [5000, 1, 4096, 2999])
    NP.write_npy_shards(fragments, manifest, tmp_dir)
    assert sorted(os.listdir(tmp_dir)) == [f"d_{k:06d}_training.npy" for k in range(4)]
    for k, t in tokens.items():
        got = np.load(f"{tmp_dir}/d_{k:06d}_training.npy")
        assert got.dtype == np.uint16 and got.tolist() == t
    for part, chunk in ((1, 64), (1000, 300), (1 << 24, 1 << 16)):
        NP.register(spark)
        rows = spark.read.format(NP.FORMAT).option("path", tmp_dir).option("part", part).option("chunk", chunk).load().collect()
        back = defaultdict(list)
        for r in sorted(rows, key=lambda r: (r.shard_id, r.pos)):
            assert r.pos == len(back[r.shard_id]) and len(r.tokens) <= chunk and (r.data_name, r.split) == ("d", "training")
            back[r.shard_id] += r.tokens
        assert back == tokens


def test_a_task_reads_many_small_shards(spark, tmp_dir):
    fragments, manifest, tokens = flat(spark, [900] * 30)
    NP.write_npy_shards(fragments, manifest, tmp_dir)
    back = NP.read_npy_shards(spark, tmp_dir)
    assert back.rdd.getNumPartitions() == 1 and {r.shard_id: r.tokens for r in back.collect()} == tokens
    some = spark.read.format(NP.FORMAT).option("path", tmp_dir).option("chunk", 500).option("part", 4500).load()
    assert 5 <= some.rdd.getNumPartitions() <= 10 and some.count() == 60


def test_arrays_that_numpy_saved_are_read(spark, tmp_dir):
    np.save(f"{tmp_dir}/web_data_000007.npy", np.arange(10, dtype=np.uint16))
    np.save(f"{tmp_dir}/web_data_000008_testing.npy", np.arange(3, dtype=np.uint16))
    open(f"{tmp_dir}/notes.txt", "w").close()
    got = sorted((r.shard_id, r.data_name, r.split, r.tokens) for r in NP.read_npy_shards(spark, tmp_dir).collect())
    assert got == [(7, "web_data", None, list(range(10))), (8, "web_data", "testing", [0, 1, 2])]
    assert NP.read_npy_shards(spark, tmp_dir, "testing").count() == 1
    assert NP.read_npy_shards(spark, tmp_dir, data_name="web").count() == 0
    np.save(f"{tmp_dir}/web_data_000009.npy", np.arange(10, dtype=np.int64))
    with pytest.raises(Exception, match="not a flat uint16 array"):
        NP.read_npy_shards(spark, tmp_dir).collect()


@pytest.mark.parametrize("n", [0, 1, 99, 10**8])
def test_header_is_numpys(n):
    raw = io.BytesIO(NP.header(n))
    assert NP.read_header(raw) == (n, len(NP.header(n))) and len(NP.header(n)) % 64 == 0
    raw.seek(0)
    assert np.lib.format.read_magic(raw) == (1, 0) and np.lib.format.read_array_header_1_0(raw) == ((n,), False, np.dtype("<u2"))


@pytest.mark.parametrize("fault", ["token", "gap", "short"])
def test_failed_write_leaves_no_file(spark, tmp_dir, fault):
    fragments, manifest, _ = flat(spark, [3000, 3000])
    if fault == "token":
        fragments = fragments.withColumn("tokens", F.when((F.col("shard_id") == 1) & (F.col("pos") == 2100), F.array(F.lit(65536))).otherwise(F.col("tokens")))
    elif fault == "gap":
        fragments = fragments.where("NOT (shard_id = 1 AND pos = 700)")
    else:
        manifest = manifest.withColumn("n_tokens", F.col("n_tokens") + F.col("shard_id"))
    with pytest.raises(Exception, match="shard d_000001"):
        NP.write_npy_shards(fragments, manifest, tmp_dir)
    assert [f for _, _, files in os.walk(tmp_dir) for f in files] == []


def test_overwrite_replaces_a_data_name_and_append_refuses(spark, tmp_dir):
    NP.write_npy_shards(*flat(spark, [10, 10, 10])[:2], tmp_dir)
    NP.write_npy_shards(*flat(spark, [10], name="other")[:2], tmp_dir)
    fragments, manifest, tokens = flat(spark, [20, 30], split="testing", seed=1)
    NP.write_npy_shards(fragments, manifest, tmp_dir)
    assert sorted(os.listdir(tmp_dir)) == ["d_000000_testing.npy", "d_000001_testing.npy", "other_000000_training.npy"]
    with pytest.raises(Exception, match="there already"):
        NP.write_npy_shards(fragments, manifest, tmp_dir, mode="append")
    assert np.load(f"{tmp_dir}/d_000001_testing.npy").tolist() == tokens[1] and len(os.listdir(tmp_dir)) == 3


# -- growing logs -------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60).map(lambda b: b.replace(b"\x00", b"\n")), st.integers(1, 9), st.integers(0, 60))
def test_ranges_give_each_whole_line_once(data, size, first):
    stream = io.BytesIO(data)
    end = LL.last_line_end(stream, 0, len(data))
    assert end == data.rfind(b"\n") + 1
    first = data.rfind(b"\n", 0, min(first, end)) + 1
    got = [line for a in range(first, end, size) for line in LL.lines_beginning_in(stream, first, a, min(a + size, end))]
    assert got == data[first:end].split(b"\n")[:-1]


def _append(path, text):
    with open(path, "ab") as f:
        f.write(text.encode())


def test_stream_reads_what_files_gain(spark, tmp_dir):
    logs, out, ck = (f"{tmp_dir}/{x}" for x in ("logs", "out", "ck"))
    os.makedirs(logs)
    a, b = (f"{logs}/{r}_log_2024_01_02_03_04.txt" for r in ("a", "run_b"))
    seen = []

    def run():
        stream = LL.growing_log_lines(spark, logs, range_bytes=7)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
        now = sorted((r.run, r.value) for r in spark.read.parquet(out).collect()) if os.path.isdir(out) else []
        gained = list((Counter(now) - Counter(seen)).elements())
        seen[:] = now
        return sorted(gained)

    _append(a, "one\ntwo lines, the second cut")
    assert run() == [("a", "one")]
    _append(a, " in two\r\n\n")
    _append(b, "first é\n")
    _append(f"{logs}/.hidden_log_2024_01_02_03_04.txt", "no\n")
    assert run() == [("a", ""), ("a", "two lines, the second cut in two"), ("run_b", "first é")]
    assert run() == []
    _append(b, "last, not ended")
    assert run() == []
    with open(b, "w") as f:
        f.write("x\n")
    with pytest.raises(Exception, match="a log may only grow"):
        run()


def test_log_files_are_files(spark, tmp_dir):
    rows = [(f"r{k % 3}_log_2024_01_02_03_04.txt", k, f"line {k}\n") for k in range(50)]
    df = spark.createDataFrame(rows, "log_file string, ord long, text string").repartition(4)
    TS.write_log_files(df.where("ord < 20"), f"{tmp_dir}/logs")
    TS.write_log_files(df, f"{tmp_dir}/logs")
    assert sorted(os.listdir(f"{tmp_dir}/logs")) == [f"r{k}_log_2024_01_02_03_04.txt" for k in range(3)]
    for k in range(3):
        with open(f"{tmp_dir}/logs/r{k}_log_2024_01_02_03_04.txt") as f:
            assert f.read() == "".join(t for n, _, t in rows if n.startswith(f"r{k}_"))
    assert TS.read_log_lines(spark, f"{tmp_dir}/logs").where("run = 'r1'").count() == 17


# -- bounded state --------------------------------------------------------------------


def _live(spark, tmp_dir, parts, spec, idle_ms=ST.IDLE_MS, restart=False):
    """Parts, one micro-batch each; returns the folder written and the checkpoint."""
    src, out, ck = (f"{tmp_dir}/{x}" for x in ("src", "out", "ck"))
    schema = "run string, step long, micro_step long, rank long, loss double, ts timestamp"
    for part in parts:
        spark.createDataFrame(part, schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
        if restart:
            ST.start_live_step_loss(spark.readStream.schema(schema).parquet(src), out, ck, spec, idle_ms=idle_ms).awaitTermination()
    if not restart:
        ST.start_live_step_loss(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), out, ck, spec, idle_ms=idle_ms).awaitTermination()
    return out, ck


def _step(run, step, places=((0, 0), (0, 1), (1, 0), (1, 1))):
    return [(run, step, m, r, 1.0 + step, f"2024-01-01 00:{step:02d}:0{m}") for m, r in places]


def test_state_holds_open_steps_only(spark, tmp_dir):
    spec = TelemetrySpec(A=2, W=2)
    parts = [[row for s in range(30) for row in _step("a", s)] + _step("a", 30, ((0, 0),)),
             _step("a", 30, ((1, 1), (0, 0))) + _step("b", 0, ((0, 0), (0, 1), (1, 0))) + _step("a", 3),
             _step("a", 30, ((1, 0), (0, 1))) + _step("b", 1, ((0, 0),))]
    out, ck = _live(spark, tmp_dir, parts, spec, restart=True)
    state = {(r.run, r.step): r.n_records for r in ST.open_state(spark, ck).collect()}
    assert state == {("b", 0): 3, ("b", 1): 1}
    assert {(r.run, r.step): r.n_records for r in ST.open_steps(spark, out, spec).collect()} == state
    got = {(r.run, r.step): (r.loss, r.n_records) for r in ST.completed_steps(spark, out, spec).collect()}
    assert got == {("a", s): (1.0 + s, 4) for s in range(31)}  # step 3 came twice and counts once


def test_idle_steps_are_written_and_late_records_still_count(spark, tmp_dir):
    spec = TelemetrySpec(A=2, W=2)
    parts = [_step("a", 0, ((0, 0), (1, 0))), _step("a", 1), _step("a", 2), _step("a", 0, ((0, 1), (1, 1)))]
    out, ck = _live(spark, tmp_dir, parts, spec, idle_ms=1)
    rows = [(r.step, r.status, r.n_records) for r in spark.read.parquet(out).collect()]
    assert (0, "expired", 2) in rows and (0, "complete", 4) not in rows
    got = {r.step: r.loss for r in ST.completed_steps(spark, out, spec).collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 3.0} and ST.open_steps(spark, out, spec).count() == 0


class _Handle:
    """State and timers of one key, in memory."""

    def __init__(self):
        self.value, self.timers, self.now = None, [], 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return self.now

    getExpiryTimeInMs = getCurrentProcessingTimeInMs


def test_a_block_of_steps_is_one_call(spark):
    handle, one = _Handle(), ST.StepRecords(full=2, idle_ms=10)
    one.init(handle)

    def call(*rows):
        part = pd.DataFrame(rows, columns=["step", "rank", "micro_step", "ts_us", "loss"])
        out = list(one.handleInputRows(("a", 0), iter([part[:1], part[1:]]), handle))
        return [(r.step, r.status, r.rank, r.ts) for o in out for r in o.itertuples()], len(out)

    assert call((3, 0, 0, 5, 1.0), (1, 0, 0, 9, 1.0), (1, 1, 0, 8, 1.0), (3, 0, 0, 4, 2.0)) == ([(1, "complete", [0, 1], [9, 8]), (3, "open", [0], [4])], 1)
    handle.now = 4
    assert call((2, 1, 0, None, 1.0)) == ([(2, "open", [1], [None])], 1) and handle.timers == [10]
    assert call((1, 1, 0, 8, 1.0)) == ([(1, "open", [1], [8])], 1) and handle.timers == [10]
    handle.now = 12
    late = [o for o in one.handleExpiredTimer(("a", 0), handle, handle)]
    assert [(r.step, r.status) for o in late for r in o.itertuples()] == [(3, "expired")] and handle.timers == [14]
    assert call((2, 0, 0, 1, 1.0)) == ([(2, "complete", [0, 1], [1, None])], 1)
    assert call((1, 0, 0, 9, 1.0)) == ([(1, "complete", [0, 1], [9, 8])], 1) and handle.timers == [] and handle.value is None
    none = list(one.handleInputRows((None, None), iter([pd.DataFrame({"step": [None], "rank": [0], "micro_step": [0], "ts_us": [1], "loss": [1.0]})]), handle))
    assert none[0].step.isna().tolist() == [True] and none[0].n_records.tolist() == [1]


# -- backoff model ----------------------------------------------------------------------


def plain_model(train, order, vocab, discount):
    """Counts as dictionaries, probability by recursion."""
    whole = Counter()
    for x, y in train:
        for j, b in enumerate(y):
            whole[tuple(x[j - k] if j >= k else None for k in range(order - 2, -1, -1)), b] += 1
    tables = {order: Counter({k: c for k, c in whole.items() if k[0][0] is not None})}
    for k in range(order - 1, 0, -1):
        cut = lambda ctx: ctx[len(ctx) - (k - 1) :] if k > 1 else ()
        kinds = {(cut(ctx), b, ctx[-k]) for (ctx, b) in whole if k == 1 or ctx[-(k - 1)] is not None}
        tables[k] = Counter((ctx, b) for ctx, b, _ in kinds)

    def p(ctx, b, k):
        if k == 0:
            return 1.0 / vocab
        mine = ctx[len(ctx) - (k - 1) :] if k > 1 else ()
        of = [n for (c, _), n in tables[k].items() if c == mine]
        low = p(ctx, b, k - 1)
        if not of or None in mine:
            return low
        return max(tables[k][mine, b] - discount, 0) / sum(of) + discount * len(of) / sum(of) * low

    return tables, p


@pytest.mark.parametrize("order", [2, 3, 4])
def test_backoff_model_equals_plain(spark, order):
    rng = np.random.default_rng(order)
    make = lambda n: [(w[:-1], w[1:]) for w in (np.minimum(rng.zipf(1.6, 9), 7).tolist() for _ in range(n))]
    train, test = make(30), make(8)
    table = lambda rows: spark.createDataFrame(rows, "x array<int>, y array<int>").repartition(3)
    counts = NG.target_counts(table(train), order)
    tables, p = plain_model(train, order, 50, 0.75)
    got = {(r.k, r.context, r.b): r.n for r in NG.ngram_counts(counts, order).collect()}
    assert got == {(k, " ".join(map(str, ctx)), b): n for k, t in tables.items() for (ctx, b), n in t.items()}
    targets = NG.target_counts(table(test), order)
    columns = NG.context_columns(order)
    for r in NG.with_probability(targets, NG.order_tables(counts, order), 50).collect():
        assert math.isclose(r.p, p(tuple(r[c] for c in columns), r.b, order), rel_tol=1e-9)
    # what a context gives all tokens adds up to one
    every = spark.createDataFrame([(*([1] * (order - 1)), b) for b in range(1, 51)], [*columns, "b"])
    every = every.select(*[F.col(c).cast("int") for c in every.columns])
    assert math.isclose(NG.with_probability(every, NG.order_tables(counts, order), 50).agg(F.sum("p")).first()[0], 1.0, rel_tol=1e-9)
    one = NG.cross_entropy(targets, counts, order, 50).first()
    flat_targets = [(tuple(x[j - k] if j >= k else None for k in range(order - 2, -1, -1)), b) for x, y in test for j, b in enumerate(y)]
    assert one.n_targets == len(flat_targets)
    assert math.isclose(one.cross_entropy, -sum(math.log(p(c, b, order)) for c, b in flat_targets) / len(flat_targets), rel_tol=1e-9)
