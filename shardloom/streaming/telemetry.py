"""I2 + I3: live step loss and throughput as telemetry records arrive, with state for open steps only.

Records ``(run, step, micro_step, rank, loss, ts)``.  A record is known by its run, step, rank and micro step, so one that is sent
again counts once, as its earliest time has it.  An arbitrary stateful operator (``transformWithState``) keeps the records of a step
until its ``W*A`` are there; then the step is written and its state ends.  A step that stays open is due after ``idle_ms`` of
processing time: without its last records it is then written as it is, marked ``expired``, and its state ends too.  So state is bounded by the
steps that are open, whatever the run's length.  There is no watermark, so no record is too late, however far the runs are apart.
State is keyed by run and block of neighbouring steps (``BLOCK_RECORDS``), with a timer for the step of the block that is due first: a
call for each step would cost more than its records.  A checkpoint of the version that was keyed by step can't be gone on from.

Every micro-batch writes, under its id (a replay replaces it), a row for each step that it touched: the step's records so far
(``W*A`` at most).  A record that comes after its step's state has ended starts a row of its own, and readers put the rows of a step
together by record, so late records count and repeated ones don't.  ``completed_steps`` gives the steps that have all ``W*A`` records, ``open_steps``
the rest, so nothing is dropped unseen.  ``loss`` equals the batch D3+D4 value; a restart with the same checkpoint resumes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..config import TelemetrySpec
from ..session import ship_package

RECORD = ("run", "step", "rank", "micro_step")
#: Processing time after which an open step is written as it is.
IDLE_MS = 3_600_000
_STATE = "step array<long>, rank array<long>, micro_step array<long>, ts array<long>, loss array<double>, due array<long>, timer long"
#: Records of a block of steps when all its steps are open, or one step's if that has more.
BLOCK_RECORDS = 8192
#: A time that is not known, in the state.
_NO_TIME = -(1 << 63)
TOUCHED = "run string, step long, status string, n_records long, rank array<long>, micro_step array<long>, ts array<long>, loss array<double>"
#: The state store that has timers, and no micro-batch without data in a run that is to end: with processing-time timers there would
#: always be another one.
_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_ENDING = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


class StepRecords(StatefulProcessor):
    """The records of the open steps of a block of steps; ``full`` of a step's end it.

    A block is called once a micro-batch and works on its records as arrays, so the calls grow with blocks, not with steps."""

    def __init__(self, full: int, idle_ms: int):
        self.full, self.idle_ms = full, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("records", _STATE)

    @staticmethod
    def _merged(records: list[np.ndarray]) -> list[np.ndarray]:
        """Records by step and place, each once as its earliest time has it; a step is due when its first one is, and touched if one is."""
        step, rank, micro, ts, loss, due, touched = records
        order = np.lexsort((np.where(np.isnan(loss), -np.inf, loss), ts, micro, rank, step))
        step, rank, micro, ts, loss, due, touched = (x[order] for x in records)
        if len(step):
            first = np.r_[True, step[1:] != step[:-1]]
            at, of = np.flatnonzero(first), np.cumsum(first) - 1
            due, touched = np.minimum.reduceat(due, at)[of], np.maximum.reduceat(touched, at)[of]
            kept = first | np.r_[True, (rank[1:] != rank[:-1]) | (micro[1:] != micro[:-1])]
            return [x[kept] for x in (step, rank, micro, ts, loss, due, touched)]
        return [step, rank, micro, ts, loss, due, touched]

    @staticmethod
    def _rows(key, records: list[np.ndarray], status) -> pd.DataFrame:
        """A row for each step of ``records``, which are in order; ``status`` says what a step with so many is."""
        step, rank, micro, ts, loss = records[:5]
        at = np.flatnonzero(np.r_[True, step[1:] != step[:-1]]).tolist()
        ends = [*at[1:], len(step)]
        times = [None if t == _NO_TIME else t for t in ts.tolist()]
        lists = [[x[a:b] for a, b in zip(at, ends)] for x in (rank.tolist(), micro.tolist(), times, loss.tolist())]
        sizes = [b - a for a, b in zip(at, ends)]
        steps = [None] * len(at) if key[1] is None else step[at].tolist()
        return pd.DataFrame({"run": [key[0]] * len(at), "step": pd.Series(steps, dtype="Int64"), "status": [status(n) for n in sizes], "n_records": sizes,
                             "rank": lists[0], "micro_step": lists[1], "ts": lists[2], "loss": lists[3]})

    def _held(self) -> tuple[list[np.ndarray], int | None]:
        """The records in the state, and its timer."""
        held = self.state.get() if self.state.exists() else None
        lists = held[:6] if held else [[]] * 6
        kinds = (np.int64, np.int64, np.int64, np.int64, np.float64, np.int64)
        records = [np.array(x, kind) for x, kind in zip(lists, kinds)]
        return [*records, np.zeros(len(records[0]), np.int64)], held[6] if held else None

    def _hold(self, records: list[np.ndarray], timer: int | None) -> None:
        """Keep the records, with a timer for the step that is due first; ``timer`` is the one that there is."""
        wanted = int(records[5].min()) if len(records[5]) else None
        if timer is not None and timer != wanted:
            self.handle.deleteTimer(timer)
        if wanted is None:
            self.state.clear()
            return
        if timer != wanted:
            self.handle.registerTimer(wanted)
        self.state.update((*(x.tolist() for x in records[:6]), wanted))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        records, timer = self._held()
        due = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        for part in rows:
            n = len(part)
            step = np.zeros(n, np.int64) if key[1] is None else part["step"].to_numpy(np.int64)
            ts = part["ts_us"].fillna(_NO_TIME).to_numpy(np.int64)
            new = [step, part["rank"].astype(np.int64).to_numpy(), part["micro_step"].astype(np.int64).to_numpy(), ts, part["loss"].to_numpy(np.float64),
                   np.full(n, due), np.ones(n, np.int64)]
            records = self._merged([np.concatenate(x) for x in zip(records, new)])
        step, touched = records[0], records[6] > 0
        _, of, sizes = np.unique(step, return_inverse=True, return_counts=True)
        self._hold([x[sizes[of] < self.full] for x in records], timer)
        if touched.any():
            yield self._rows(key, [x[touched] for x in records], lambda n: "complete" if n >= self.full else "open")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        records, timer = self._held()
        over = records[5] <= max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs())
        if over.any():
            self._hold([x[~over] for x in records], timer)
            yield self._rows(key, [x[over] for x in records], lambda n: "expired")

    def close(self) -> None:
        pass


def live_steps(records: DataFrame, spec: TelemetrySpec = TelemetrySpec(), idle_ms: int = IDLE_MS) -> DataFrame:
    """The stream of steps that micro-batches touch: ``TOUCHED``, times in microseconds."""
    ship_package(records.sparkSession)
    us = F.expr("unix_micros(cast(ts as timestamp))").alias("ts_us")
    full = spec.W * spec.A
    rows = records.select("run", F.col("step").cast("long"), F.col("rank").cast("long"), F.col("micro_step").cast("long"), F.col("loss").cast("double"), us)
    rows = rows.withColumn("block", F.expr(f"step div {max(1, BLOCK_RECORDS // full)}"))
    return rows.groupBy("run", "block").transformWithStateInPandas(
        statefulProcessor=StepRecords(full, idle_ms), outputStructType=TOUCHED, outputMode="Update", timeMode="ProcessingTime")


def start_live_step_loss(records: DataFrame, out: str, checkpoint: str, spec: TelemetrySpec = TelemetrySpec(),
                         available_now: bool = True, idle_ms: int = IDLE_MS) -> StreamingQuery:
    """Start the stream; the session's own settings come back once the query has taken these.

    With ``available_now`` it ends with the data there is; timers are then looked at in micro-batches that have data."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch_id={batch_id}")

    conf, wanted = records.sparkSession.conf, _CONF | (_ENDING if available_now else {})
    before = {key: conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        conf.set(key, value)
    try:
        w = (live_steps(records, spec, idle_ms).writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint))
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
        return w.start()
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def live_records(spark: SparkSession, out: str) -> DataFrame:
    """Each record that the stream has written once: of one sent more than once the earliest."""
    each = spark.read.parquet(out).select("run", "step", F.explode(F.arrays_zip("rank", "micro_step", "ts", "loss")).alias("r"))
    first = F.min(F.struct(F.timestamp_micros("r.ts").alias("ts"), F.col("r.loss").alias("loss"))).alias("first")
    return each.groupBy("run", "step", F.col("r.rank").alias("rank"), F.col("r.micro_step").alias("micro_step")).agg(first).select(*RECORD, "first.*")


def _latest(spark: SparkSession, out: str, spec: TelemetrySpec) -> DataFrame:
    """Each step from the records written so far."""
    return live_records(spark, out).groupBy("run", "step").agg(
        (F.sum(F.col("loss") / F.lit(float(spec.A))) / F.lit(float(spec.W))).alias("loss"),
        F.count(F.lit(1)).alias("n_records"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))


def completed_steps(spark: SparkSession, out: str, spec: TelemetrySpec = TelemetrySpec()) -> DataFrame:
    """Steps with all their records: loss, duration and throughput (D8; null for a zero duration)."""
    dt_ms = F.expr("timestampdiff(MICROSECOND, t0, t1)") / F.lit(1000.0)
    tokens = float(spec.B * spec.T * spec.A * spec.W)
    rows = _latest(spark, out, spec).where(F.col("n_records") >= spec.W * spec.A).withColumn("dt_ms", dt_ms)
    return rows.withColumn("tok_per_sec", F.when(F.col("dt_ms") > 0, F.lit(tokens) / (F.col("dt_ms") / F.lit(1000.0))))


def open_steps(spark: SparkSession, out: str, spec: TelemetrySpec = TelemetrySpec()) -> DataFrame:
    """Steps that still miss records: how many they have."""
    return _latest(spark, out, spec).where(F.col("n_records") < spec.W * spec.A).select("run", "step", "n_records")


def open_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What the stream's state holds after its last micro-batch: ``(run, step, n_records)`` of each open step."""
    held = spark.read.format("statestore").option("stateVarName", "records").load(checkpoint)
    each = held.select("key.run", "key.block", F.explode("value.step").alias("step"))
    step = F.when(F.col("block").isNotNull(), F.col("step")).alias("step")
    return each.groupBy("run", step).agg(F.count(F.lit(1)).alias("n_records"))
