"""Run telemetry sources: step records derived from an event table, the
training-log text format (A8, H11, H12) and the available-runs check (A10).

Telemetry rows are ``(run, step, micro_step, rank, loss, ts)``: what the
reference's trainer produces per micro batch and rank before it averages.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LOG_NAME_TIME_FORMAT, STEP_LOG_FORMAT, TelemetrySpec
from ..plans.ordering import row_index

TELEMETRY_COLUMNS = ("run", "step", "micro_step", "rank", "loss", "ts")


def telemetry_from_events(events: DataFrame, spec: TelemetrySpec = TelemetrySpec()) -> DataFrame:
    """Per ``event_type`` (the run), number records by ``(ts, event_id)`` and
    deal them to ``W`` ranks and ``A`` micro steps:
    ``rank = i % W``, ``micro_step = (i div W) % A``, ``step = i div (W*A)``;
    only complete steps (``W*A`` records) are kept, ``leftover_records``
    reports the rest.  The numbering is the skew-safe ``row_index`` (a run may
    hold a third of all records), which knows each run's count as well."""
    return dealt_records(events, spec).where("complete").drop("complete")


def dealt_records(events: DataFrame, spec: TelemetrySpec = TelemetrySpec()) -> DataFrame:
    """Every record with its place, and whether its step is ``complete``."""
    W, A = spec.W, spec.A
    ev = events.select(F.col("event_type").alias("run"), "event_id", "ts",
                       F.col("value").alias("loss"))
    idx = row_index(ev, ["run"], ["ts", "event_id"], "i", count_col="_cnt")
    return idx.select(
        "run",
        F.expr(f"i div {W * A}").alias("step"),
        F.expr(f"(i div {W}) % {A}").alias("micro_step"),
        F.expr(f"i % {W}").alias("rank"),
        "loss", "ts", (F.col("i") < F.expr(f"_cnt div {W * A}") * F.lit(W * A)).alias("complete"))


def leftover_records(dealt: DataFrame) -> DataFrame:
    """Per run: its records, and those of a last step that is not complete."""
    return dealt.groupBy("run").agg(F.count(F.lit(1)).alias("n_records"),
                                    F.sum((~F.col("complete")).cast("long")).alias("n_leftover"))


def _number(x: Column, pattern: str) -> Column:
    """A double as C's printf gives it: the exact binary value rounded half to
    even (decimal formats round the exact value, ``format_string`` rounds its
    shortest decimal form); ``nan`` (also for null) and ``inf`` by name."""
    digits = F.lower(F.call_function("format_number", x, F.lit(pattern)))
    if "E" in pattern:
        digits = F.regexp_replace(digits, "e(?=[0-9])", "e+")
    return (F.when(x.isNull() | F.isnan(x), F.lit("nan"))
            .when(x == float("inf"), F.lit("inf")).when(x == float("-inf"), F.lit("-inf")).otherwise(digits))


def fixed(x: Column, digits: int) -> Column:
    """``%.<digits>f``."""
    return _number(x, "0." + "0" * digits)


def format_step_line(step: Column, loss: Column, lr: Column, norm: Column,
                     dt_ms: Column, tok_per_sec: Column) -> Column:
    """The trainer's step message; a value that is not known is ``nan``."""
    shown = STEP_LOG_FORMAT.replace("%.6f", "%s").replace("%.4e", "%s").replace("%.4f", "%s").replace("%.2f", "%s")
    return F.format_string(shown, step.cast("int"), fixed(loss, 6), _number(lr, "0.0000E00"), fixed(norm, 4),
                           fixed(dt_ms, 2), fixed(tok_per_sec, 2))


def log_line(ts: Column, message: Column, level: str = "INFO") -> Column:
    """Logger prefix ``asctime levelname message`` (asctime with milliseconds)."""
    return F.concat_ws(" ", F.date_format(ts, "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(level), message)


def log_file_name(run: Column, ts: Column) -> Column:
    """``{run}_log_{%Y_%m_%d_%H_%M}.txt``."""
    return F.concat(run, F.lit("_log_"), F.date_format(ts, LOG_NAME_TIME_FORMAT), F.lit(".txt"))


_NUM = r"(-?[0-9.]+(?:e[-+][0-9]+)?|nan|-?inf)"
STEP_LINE_PATTERN = (r"step\s+(-?\d+) \| loss: " + _NUM + r" \| lr " + _NUM + r" \| norm: " + _NUM
                     + r" \| dt: " + _NUM + r"ms \| tok/sec: " + _NUM)
# the run is the name part before ``_log_<time>.txt``, as a file or a folder
LOG_FILE_PATTERN = r"([^/=]+)_log_\d{4}_\d{2}_\d{2}_\d{2}_\d{2}\.txt(?:/|$)"


def parse_step_lines(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Step lines back into columns; other log lines are not steps, and
    ``step_line_report`` counts lines that look like steps but are not."""
    t = F.col(text_col)
    g = lambda i: F.regexp_extract(t, STEP_LINE_PATTERN, i)
    out = lines.where(t.rlike(STEP_LINE_PATTERN))
    return out.select(
        *[c for c in lines.columns if c != text_col],
        g(1).cast("long").alias("step"), g(2).cast("double").alias("loss"),
        g(3).cast("double").alias("lr"), g(4).cast("double").alias("norm"),
        g(5).cast("double").alias("dt_ms"), g(6).cast("double").alias("tok_per_sec"))


def step_line_report(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Per run: log lines, step lines read, and lines that begin a step message
    but cannot be read."""
    t = F.col(text_col)
    read, looks = t.rlike(STEP_LINE_PATTERN), t.rlike(r"(^|\s)step\s")
    return lines.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(read.cast("long")).alias("n_steps"),
        F.sum((looks & ~read).cast("long")).alias("n_unread"))


def read_log_lines(spark, path: str) -> DataFrame:
    """Lines ``(run, value)`` of log files; the run comes from the file name."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("_file"))
    return lines.withColumn("run", F.regexp_extract("_file", LOG_FILE_PATTERN, 1)).drop("_file")


def read_training_logs(spark, path: str) -> DataFrame:
    """Scan log files."""
    return parse_step_lines(read_log_lines(spark, path))


def write_training_logs(lines: DataFrame, path: str) -> None:
    """Write ``(log_file, value)`` lines as text, one folder per log file name
    (Spark names the part files; the log name is the folder)."""
    lines.select("log_file", "value").write.mode("overwrite").partitionBy("log_file").text(path)


def write_log_files(lines: DataFrame, path: str) -> None:
    """A8 sink: rows ``(log_file, ord, text)`` as one file per log name, as a
    run writes it; ``text`` carries its own line end.

    A file's rows come together and stream into it in order.  Each is written
    under a hidden name and moved to its own when it is whole, so a task that
    runs again replaces it, and a longer version replaces a shorter one."""
    import pyarrow as pa

    from ..session import ship_package
    from .npy import file_system

    spark = lines.sparkSession
    ship_package(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.select("log_file", "ord", "text").repartition(parts, "log_file").sortWithinPartitions("log_file", "ord")

    def run(batches):
        import uuid

        store, top = file_system(path)
        store.create_dir(top, recursive=True)
        name, stream, hidden, written = None, None, "", 0

        def close():
            stream.close()
            store.move(hidden, f"{top}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([written], pa.int64())], names=["log_file", "bytes"])

        for batch in batches:
            for log_file, text in zip(batch.column("log_file").to_pylist(), batch.column("text").to_pylist()):
                if log_file != name:
                    if stream is not None:
                        yield close()
                    name, hidden, written = log_file, f"{top}/.{log_file}-{uuid.uuid4().hex}", 0
                    stream = store.open_output_stream(hidden)
                data = text.encode()
                stream.write(data)
                written += len(data)
        if stream is not None:
            yield close()

    rows.mapInArrow(run, "log_file string, bytes long").write.format("noop").mode("overwrite").save()


def available_runs(requested: Sequence[str], telemetry: DataFrame) -> DataFrame:
    """A10: requested runs that have saved state, in request order."""
    spark = telemetry.sparkSession
    req = spark.createDataFrame([(i, r) for i, r in enumerate(requested)], "req_ord int, run string")
    have = telemetry.select("run").distinct()
    return req.join(have, "run", "left_semi").select("req_ord", "run")
