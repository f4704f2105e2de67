"""I1 + I3: incremental shard packing over an append-only document stream.

State is the stream position (global token offset) at the end of the last
committed micro-batch.  It lives in a ledger table keyed by ``batch_id`` next
to the output, written *after* the batch's fragments:

* the base offset of batch ``b`` is the largest ``end`` among ledger rows with
  a smaller batch id, so a replayed batch (crash between the data write and
  the ledger write) recomputes the same base;
* fragments go to ``data/batch_id=<b>`` with overwrite, so the replay replaces
  its own output instead of duplicating it.

Restarting the query with the same ``checkpointLocation`` resumes after the
last committed batch (I3).  Within a batch, documents are ordered by
``(source_ord, doc_ord)``; batches follow arrival order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import PackSpec, SplitRatio
from ..operators.packing import fragments_at, label_splits, named_manifest, shard_manifest, stage_token_table
from ..operators.tokenize import Tokenizer
from ..plans.ordering import with_offsets
from ..session import stage_table, staging_scope

LEDGER_SCHEMA = "start long, end long, batch_id long"


def ledger_path(out: str) -> str:
    return f"{out.rstrip('/')}/_ledger"


def data_path(out: str) -> str:
    return f"{out.rstrip('/')}/data"


def manifest_path(out: str) -> str:
    return f"{out.rstrip('/')}/_manifest"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _base_offset(spark: SparkSession, out: str, batch_id: int) -> int:
    """Where the stream stands: 0 without a ledger; a ledger that cannot be
    read is an error, never a new start."""
    if not _exists(spark, ledger_path(out)):
        return 0
    led = spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path(out))
    row = led.where(F.col("batch_id") < batch_id).agg(F.max("end").alias("e")).collect()[0]
    return int(row.e or 0)


#: What a stream that was asked to stop says.
STOPPED = "stopped before the ledger"


def pack_batch(batch: DataFrame, batch_id: int, out: str, tok: Tokenizer, spec: PackSpec,
               ratio: SplitRatio = SplitRatio(), stop_before_ledger: int | None = None) -> None:
    """The ``foreachBatch`` body; safe to call again for the same id.

    The micro-batch is encoded once into a staged table, which its offsets,
    fragments, manifest rows and ledger total read; what it stages is removed
    before the ledger is written, so an endless stream fills no folder."""
    spark = batch.sparkSession
    base = _base_offset(spark, out, batch_id)
    with staging_scope(spark, "micro-batch"):
        tokens = stage_token_table(batch.select("source_ord", "doc_ord", "text"), tok)
        offsets = with_offsets(tokens.select("source_ord", "doc_ord", "n"), "n", spec.ranges)
        offsets = stage_table(offsets.withColumn("g", F.col("g") + F.lit(base)), "batch-offsets")
        placed = tokens.join(offsets.drop("n"), ["source_ord", "doc_ord"])
        frags = label_splits(fragments_at(placed, spec.shard_tokens), ratio)
        frags.write.mode("overwrite").parquet(f"{data_path(out)}/batch_id={batch_id}")
        part = shard_manifest(offsets, spec, None).select("shard_id", "n_tokens", "n_docs")
        part.write.mode("overwrite").parquet(f"{manifest_path(out)}/batch_id={batch_id}")
        total = offsets.agg(F.sum("n").alias("s")).collect()[0].s or 0
    if batch_id == stop_before_ledger:
        raise RuntimeError(STOPPED)
    ledger = spark.createDataFrame([(base, base + int(total))], "start long, end long")
    ledger.write.mode("overwrite").parquet(f"{ledger_path(out)}/batch_id={batch_id}")


def start_incremental_packing(docs_stream: DataFrame, out: str, checkpoint: str, tok: Tokenizer,
                              spec: PackSpec, available_now: bool = True,
                              ratio: SplitRatio = SplitRatio(), stop_before_ledger: int | None = None) -> StreamingQuery:
    """Run I1 over a streaming ``(source_ord, doc_ord, text)`` DataFrame;
    ``stop_before_ledger`` names a micro-batch that fails where a crash is worst (for drills)."""
    writer = (docs_stream.writeStream
              .foreachBatch(lambda df, bid: pack_batch(df, bid, out, tok, spec, ratio, stop_before_ledger))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def _committed(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path(out)).select("batch_id")


def read_packed(spark: SparkSession, out: str) -> DataFrame:
    """Fragments written by all committed batches (ledger-confirmed only)."""
    return spark.read.parquet(data_path(out)).join(_committed(spark, out), "batch_id", "left_semi").drop("batch_id")


def read_stream_manifest(spark: SparkSession, out: str, spec: PackSpec, ratio: SplitRatio = SplitRatio()) -> DataFrame:
    """The manifest so far: a shard may have pieces of several batches."""
    parts = spark.read.parquet(manifest_path(out)).join(_committed(spark, out), "batch_id", "left_semi")
    return named_manifest(parts.groupBy("shard_id").agg(F.sum("n_tokens").cast("long").alias("n_tokens"),
                                                        F.sum("n_docs").cast("long").alias("n_docs")), spec, ratio)
