"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory, over the driver's whole tables.

Fixed parameters for the test scale (see FIXTURES.md): shards of 20,000
tokens, windows of T=128 with N=4 (the
count model uses N=1), B=2, W=2, 8/1/1 split; telemetry dealt to W=2 ranks and
A=4 micro steps; generation up to 48 tokens with top-5 sampling, seed 42.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Dict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import batches as BA
from ..operators import countmodel as CM
from ..operators import generate as GE
from ..operators import packing as PK
from ..operators import telemetry as TM
from ..operators import windows as WI
from ..operators.tokenize import ByteTokenizer, WordTokenizer, token_range_report, tokenize_documents
from ..session import on_drop, read_table, stage_table, staging_path
from ..sources import corpus as CO
from ..sources import shards as SH
from ..sources import telemetry as TS

# Fixed parameters of the registered queries.
DATA_NAME = "docs"
SHARD_TOKENS = 20_000
BYTE_SHARD_TOKENS = 200_000
SEQ_T, SEQ_N = 128, 4
LM_N = 1
LOADER = C.WindowSpec(B=2, T=SEQ_T, N=SEQ_N, W=2)
LM_LOADER = C.WindowSpec(B=LOADER.B, T=SEQ_T, N=LM_N, W=LOADER.W)
SCHEDULE_ACCUM, SCHEDULE_STEPS = 2, 500
TEL = C.TelemetrySpec(A=4, W=2, warmup_steps=20)
GEN_MAX_LENGTH = 48
HORIZON_LENGTH = 144
CURVE_WIDTH = 24                   # pixel columns of a reduced curve
LOSS_BLOCK = 100                   # steps per loss map
TEST_STEPS = 120                   # loader calls of ``test_losses`` where a caller names no number; no registered query uses it
WHOLE_EXTRA = 8                    # loader calls beyond the longest round, when the whole testing split is read
GEN_RUN = "bigram"
CONTEXT_SIZE = 16
PAD_CONTEXT = 64
REQUESTED_RUNS = ("view", "click", "purchase", "checkout", "signup")
RATIO = C.SplitRatio(8, 1, 1)
RESPLIT_RATIO = C.SplitRatio(6, 3, 1)
REPORT_LIMIT = 1000                # a token limit that documents break
REPORT_RATIOS = ((8, 1, 1), (6, 3, 1), (10, 0, 0), (5, 3, 1), (11, -1, 0))
ACCUM_TOKENS = 8192                # tokens of an optimiser step in the report of accumulation steps
ACCUM_B, ACCUM_W = (2, 3, 8), (1, 2)

PACK = C.PackSpec(data_name=DATA_NAME, shard_tokens=SHARD_TOKENS)


# -- shared building blocks ---------------------------------------------------

def docs(spark: SparkSession, sf: str) -> DataFrame:
    return CO.text_documents(spark, sf)


_TOKENIZERS: Dict[tuple, WordTokenizer] = {}


def word_tokenizer(spark: SparkSession, sf: str) -> WordTokenizer:
    """Fitted once per application and data folder (the vocabulary is capped,
    so keeping it on the driver is bounded)."""
    key = (spark.sparkContext.applicationId, sf, _stamp(spark, sf))
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = WordTokenizer.fit(docs(spark, sf))
    return _TOKENIZERS[key]


def tokens(spark, sf) -> DataFrame:
    """The documents encoded once: counts, offsets and fragments read this."""
    return _prepared(spark, sf, "doc-tokens", lambda: tokenize_documents(docs(spark, sf), word_tokenizer(spark, sf)))


def offsets(spark, sf) -> DataFrame:
    return PK.doc_offsets(tokens(spark, sf), word_tokenizer(spark, sf), PACK, tokenized=True)


def prepared_offsets(spark, sf) -> DataFrame:
    """Document offsets, written once for the readers of the manifest family."""
    return _prepared(spark, sf, "doc-offsets", lambda: offsets(spark, sf))


def manifest(spark, sf, pack: C.PackSpec = PACK) -> DataFrame:
    return PK.shard_manifest(prepared_offsets(spark, sf), pack, RATIO)


def prepared_manifest(spark, sf) -> DataFrame:
    """The shard manifest written beside the shards, for its readers."""
    return _prepared(spark, sf, "manifest", lambda: manifest(spark, sf))


def fragments(spark, sf) -> DataFrame:
    placed = tokens(spark, sf).join(prepared_offsets(spark, sf).drop("n"), ["source_ord", "doc_ord"])
    return PK.label_splits(PK.fragments_at(placed, SHARD_TOKENS), RATIO)


_PREPARED: Dict[tuple, str] = {}


@on_drop
def _forget(app: str) -> None:
    for cache in (_PREPARED, _TOKENIZERS):
        for key in [k for k in cache if k[0] == app]:
            del cache[key]


def _stamp(spark: SparkSession, sf: str) -> str:
    """Names, sizes and times of the files under a data folder: tables derived
    from it are used again only while it is unchanged."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(sf)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = [f"{s.getPath().getName()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(path)]
    return "|".join(sorted(rows))


def _prepared(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from the inputs, written once per application and data
    folder under the checkpoint folder and read by every later query — as a
    prepared corpus is written once and read by training and evaluation."""
    key = (spark.sparkContext.applicationId, sf, _stamp(spark, sf), name)
    if key not in _PREPARED:
        path = staging_path(spark, name)
        build().write.mode("overwrite").parquet(path)
        _PREPARED[key] = path
    return spark.read.parquet(_PREPARED[key])


def packed_shards(spark, sf) -> DataFrame:
    """The packed, labelled fragments (the shard files a loader reads)."""
    return _prepared(spark, sf, "fragments", lambda: fragments(spark, sf))


def seqs(spark, sf, N: int) -> DataFrame:
    return WI.sequences(packed_shards(spark, sf), SEQ_T, N)


def lm_counts(spark, sf) -> DataFrame:
    """Training-split pair counts at horizon 1 (the count model)."""
    return all_split_counts(spark, sf).where(F.col("split") == "training").select("a", "b", "c")


def all_split_counts(spark, sf) -> DataFrame:
    """Pair counts of every split from one pass, written once."""
    return _prepared(spark, sf, "split-pair-counts", lambda: CM.split_pair_counts(seqs(spark, sf, LM_N)))


def telemetry(spark, sf) -> DataFrame:
    """Run records derived from ``events``, written once."""
    return _prepared(spark, sf, "telemetry",
                     lambda: TS.telemetry_from_events(read_table(spark, sf, "events"), TEL))


def steps(spark, sf) -> DataFrame:
    return TM.step_table(telemetry(spark, sf), TEL)


def _txt(col: str) -> F.Column:
    return F.array_join(F.col(col), " ")


def _r(col: str, digits: int = 6) -> F.Column:
    return F.round(F.col(col), digits).alias(col)


# -- sources, projections ----------------------------------------------------

def q_corpus_scan(spark, sf):
    return CO.text_documents(spark, sf, where="lang = 'en'")


def q_project_keys(spark, sf):
    return CO.instruction_pairs(read_table(spark, sf, "conversations"))


def q_concat_keys(spark, sf):
    return CO.conversation_documents(spark, sf, separator=" ")


def q_concat_pair(spark, sf):
    return CO.conversation_documents(spark, sf, separator="").select("doc_ord", "text")


def q_union_sources(spark, sf):
    both = CO.union_sources([CO.conversation_documents(spark, sf, 0), CO.text_documents(spark, sf, 1)])
    return PK.doc_offsets(both, word_tokenizer(spark, sf), PACK)


def q_doc_offsets(spark, sf):
    return offsets(spark, sf)


# -- shards -------------------------------------------------------------------

def q_shard_manifest(spark, sf):
    return manifest(spark, sf)


def q_split_shards(spark, sf):
    return manifest(spark, sf).select("shard_id", "split")


def q_split_counts(spark, sf):
    return PK.split_counts(manifest(spark, sf))


def q_strip_split_label(spark, sf):
    pack = C.PackSpec(data_name="docs_testing", shard_tokens=SHARD_TOKENS)
    m = manifest(spark, sf, pack)
    return m.select("shard_id", "file_name", SH.strip_label(F.col("file_name")).alias("stripped"))


def q_shard_catalog(spark, sf):
    return SH.shard_catalog(manifest(spark, sf), "training").select(
        "shard_id", "shard_name", "file_name", "n_tokens")


def q_pack_shards(spark, sf):
    f = fragments(spark, sf)
    return f.select("source_ord", "doc_ord", "shard_id", "pos",
                    F.size("tokens").cast("long").alias("length"), _txt("tokens").alias("tokens_text"))


def q_shard_scan(spark, sf):
    """A2 + A3: write the shards partitioned by split and shard, read the
    training split back (partition pruning), widen to long."""
    path = staging_path(spark, "shards")
    SH.write_shards(packed_shards(spark, sf), prepared_manifest(spark, sf), path, DATA_NAME)
    back = SH.read_shards(spark, path, "training", data_name=DATA_NAME)
    return back.select("shard_id", "pos", "doc_ord",
                       F.array_join(F.col("tokens").cast("array<long>"), " ").alias("tokens_text"))


def q_resplit(spark, sf):
    """A6 + A7 + B6 + A3: the shards of a versioned store labelled again with
    another ratio, as a new manifest alone; what the validation split then
    holds is read through it."""
    from ..sources import store as ST

    path = staging_path(spark, "store")
    ST.create(packed_shards(spark, sf), prepared_manifest(spark, sf), path, DATA_NAME)
    version = ST.resplit(spark, path, DATA_NAME, RESPLIT_RATIO, allow_empty_split=True)
    new = ST.manifest_of(spark, path, DATA_NAME, version)
    held = ST.read_split(spark, path, DATA_NAME, "validation", version).groupBy("shard_id").agg(F.sum("length").alias("n_read"))
    return new.join(held, "shard_id", "left").select("shard_id", "file_name", "split", "n_tokens", "n_read")


def q_round_trip(spark, sf):
    """C4: documents and those that decoding their ids does not give back."""
    tok = word_tokenizer(spark, sf)
    back = docs(spark, sf).withColumn("back", tok.decode(tok.encode(F.col("text"), eot=False)))
    return back.agg(F.count(F.lit(1)).alias("n_docs"),
                    F.sum((F.col("back") != F.col("text")).cast("long")).alias("n_differing"))


def q_token_range_report(spark, sf):
    """B4, report form, against a limit that real ids break."""
    return token_range_report(tokens(spark, sf), limit=REPORT_LIMIT)


def q_byte_manifest(spark, sf):
    pack = C.PackSpec(data_name="bytes", shard_tokens=BYTE_SHARD_TOKENS)
    off = PK.doc_offsets(docs(spark, sf), ByteTokenizer(spark), pack)
    return PK.shard_manifest(off, pack, RATIO).select("shard_id", "n_tokens", "n_docs")


def q_byte_fragments(spark, sf):
    pack = C.PackSpec(data_name="bytes", shard_tokens=BYTE_SHARD_TOKENS)
    f = PK.pack_fragments(docs(spark, sf), ByteTokenizer(spark), pack)
    return f.select("doc_ord", "shard_id", "pos", F.size("tokens").cast("long").alias("length"),
                    F.aggregate("tokens", F.lit(0).cast("long"), lambda acc, t: acc + t).alias("token_sum"))


# -- windows, batches ---------------------------------------------------------

def q_sequences(spark, sf):
    s = seqs(spark, sf, SEQ_N)
    return s.select("split", "shard_id", "seq", _txt("x").alias("x_text"), _txt("y").alias("y_text"))


def q_target_pairs(spark, sf):
    return WI.target_pairs(seqs(spark, sf, SEQ_N), SEQ_T)


def q_rank_batches(spark, sf):
    return BA.rank_batches(SH.shard_catalog(prepared_manifest(spark, sf), "training"), LOADER)


def q_batch_schedule(spark, sf):
    return BA.batch_schedule(SH.shard_catalog(prepared_manifest(spark, sf), "training"), LOADER,
                             SCHEDULE_ACCUM, SCHEDULE_STEPS)


def q_step_batches(spark, sf):
    """The sequences (x, y) each rank reads at each micro step: the
    schedule expanded to its B rows, equi-joined to the sequences."""
    # the schedule table (steps x A x W rows) is written once: both the row
    # expansion and the fragment ranges read it
    sched = stage_table(BA.batch_schedule(SH.shard_catalog(prepared_manifest(spark, sf), "training"), LOADER,
                                          SCHEDULE_ACCUM, SCHEDULE_STEPS), "schedule")
    rows = BA.schedule_sequences(sched, LOADER).select(
        "step", "micro_step", "rank", F.col("row").alias("batch_row"), "shard_id", "seq")
    train = packed_shards(spark, sf).where(F.col("split") == "training")
    s = WI.sequences(BA.scheduled_fragments(train, sched, LOADER), SEQ_T, SEQ_N)
    s = s.select("shard_id", "seq", _txt("x").alias("x_text"), _txt("y").alias("y_text"))
    return rows.join(s, ["shard_id", "seq"])


# -- count model --------------------------------------------------------------

def q_next_token_counts(spark, sf):
    train = seqs(spark, sf, LM_N).where(F.col("split") == "training")
    return CM.next_token_counts(train)


def q_test_cross_entropy(spark, sf):
    allc = all_split_counts(spark, sf)
    counts = allc.where(F.col("split") == "training").select("a", "b", "c")
    test = allc.where(F.col("split") == "testing").select("a", "b", F.col("c").alias("n"))
    ce = CM.cross_entropy_counts(test, counts, word_tokenizer(spark, sf).vocab_size)
    return ce.select("n_targets", _r("cross_entropy"))


def q_topk_next(spark, sf):
    return CM.topk_next(lm_counts(spark, sf))


def q_topk_bounded(spark, sf):
    """E6 in bounded space: summaries of at most ``HH.M`` counters a context
    and task, then exact counts of what they leave open."""
    from ..operators import heavyhitters as HH

    return HH.topk_bounded(seqs(spark, sf, LM_N).where(F.col("split") == "training"))


def q_next_token_probs(spark, sf):
    p = CM.next_token_probs(lm_counts(spark, sf), word_tokenizer(spark, sf).vocab_size)
    return p.select("a", "b", "c", _r("p"))


def q_encode_vocab(spark, sf):
    return WordTokenizer.vocabulary(docs(spark, sf))


def prompt_tokens(spark, sf) -> DataFrame:
    tok = word_tokenizer(spark, sf)
    bench = read_table(spark, sf, "benchmark")
    return bench.select("item_id", tok.encode(F.col("text"), eot=False).alias("tokens"))


def q_encode_prompts(spark, sf):
    p = prompt_tokens(spark, sf)
    return p.select("item_id", F.size("tokens").cast("long").alias("n_tokens"), _txt("tokens").alias("tokens_text"))


def q_decode_prompts(spark, sf):
    tok = word_tokenizer(spark, sf)
    return prompt_tokens(spark, sf).select("item_id", tok.decode(F.col("tokens")).alias("text"))


def q_prepare_prompts(spark, sf):
    tok = word_tokenizer(spark, sf)
    pad = tok.words.index("") + 1 if "" in tok.words else C.WORD_SPELL_ID
    p = prompt_tokens(spark, sf)
    return p.select(
        "item_id",
        F.array_join(GE.tail_context(F.col("tokens"), CONTEXT_SIZE), " ").alias("tail_text"),
        F.array_join(GE.head_context(F.col("tokens"), CONTEXT_SIZE), " ").alias("head_text"),
        F.array_join(GE.prepare_prompts(F.col("tokens"), PAD_CONTEXT, pad), " ").alias("padded_text"))


def generated(spark, sf) -> DataFrame:
    tok = word_tokenizer(spark, sf)
    counts = lm_counts(spark, sf)
    prompts = GE.prompt_matrix(prompt_tokens(spark, sf), [GEN_RUN])
    return GE.generate(prompts, CM.topk_next(counts), CM.backoff_topk(counts),
                       GEN_MAX_LENGTH, tok.vocab_size)


def q_generate_text(spark, sf):
    tok = word_tokenizer(spark, sf)
    g = generated(spark, sf)
    return g.select("run", "item_id", _txt("tokens").alias("tokens_text"),
                    tok.decode(F.col("tokens")).alias("response"))


def q_responses_pivot(spark, sf):
    tok = word_tokenizer(spark, sf)
    g = generated(spark, sf).withColumn("response", tok.decode(F.col("tokens")))
    return GE.responses_pivot(g, [GEN_RUN])


def q_prompt_matrix(spark, sf):
    runs = [r.run for r in TS.available_runs(REQUESTED_RUNS, telemetry(spark, sf))
            .orderBy("req_ord").collect()]          # at most len(REQUESTED_RUNS) rows
    bench = read_table(spark, sf, "benchmark").select("item_id")
    return GE.prompt_matrix(bench, runs).select("run", "item_id")


# -- telemetry ----------------------------------------------------------------

def q_step_loss(spark, sf):
    return TM.step_loss(telemetry(spark, sf), TEL).select("run", "step", _r("loss"))


def q_loss_curve(spark, sf):
    c = TM.loss_curve(TM.step_loss(telemetry(spark, sf), TEL))
    return c.select("run", "step", _r("loss"), _r("log10_loss"))


def q_curve_pixels(spark, sf):
    """G2 for plotting: all runs' curves on shared axes, ``CURVE_WIDTH`` pixel
    columns wide, as the points that draw the same picture."""
    c = TM.curve_pixels(TM.step_loss(telemetry(spark, sf), TEL).select("run", "step", _r("loss")), CURVE_WIDTH)
    return c.select("run", "px", "step", "loss")


def q_step_duration(spark, sf):
    return TM.step_duration(telemetry(spark, sf)).select("run", "step", "dt_ms")


def q_throughput(spark, sf):
    t = TM.throughput(TM.step_duration(telemetry(spark, sf)), TEL)
    return t.select("run", "step", "dt_ms", _r("tok_per_sec", 4))


def q_lr_schedule(spark, sf):
    return steps(spark, sf).select("run", "step", _r("lr", 12))


def q_curriculum_stage(spark, sf):
    return steps(spark, sf).select("run", "step", "max_steps", "stage")


def q_checkpoint_steps(spark, sf):
    return TM.checkpoint_steps(steps(spark, sf)).select("run", "step", _r("loss"))


def q_resume_point(spark, sf):
    return TM.resume_point(TM.step_loss(telemetry(spark, sf), TEL))


def q_run_summary(spark, sf):
    s = TM.run_summary(steps(spark, sf), whole_test_loss(spark, sf))
    return s.select("run", "n_steps", _r("final_loss"), _r("min_loss"), _r("mean_dt_ms", 4),
                    _r("mean_tok_per_sec", 4), _r("test_loss"))


def q_log_format(spark, sf):
    return TM.step_log_lines(steps(spark, sf))


def q_log_parse(spark, sf):
    lines = TM.step_log_lines(steps(spark, sf)).select("run", F.col("line").alias("value"))
    return TS.parse_step_lines(lines).drop("norm")


def q_log_name(spark, sf):
    t = telemetry(spark, sf).groupBy("run").agg(F.min("ts").alias("t0"))
    return t.select("run", TS.log_file_name(F.col("run"), F.col("t0")).alias("log_file"))


def q_available_runs(spark, sf):
    return TS.available_runs(REQUESTED_RUNS, telemetry(spark, sf))


def q_map_has_prefix(spark, sf):
    m = TM.stage_maps(steps(spark, sf))
    return m.select("run", TM.map_has_prefix(F.col("state_keys"), "stage_3").alias("has_stage_3"),
                    TM.map_has_prefix(F.col("state_keys"), "stage_9").alias("has_stage_9"))


def q_loss_map(spark, sf):
    """D5, each map shown as its entries in order."""
    m = TM.loss_map(TM.step_loss(telemetry(spark, sf), TEL), LOSS_BLOCK)
    entry = lambda e: F.concat(e["key"].cast("string"), F.lit(":"), TS.fixed(e["value"], 6))
    shown = F.array_join(F.transform(F.map_entries("loss_per_step"), entry), " ")
    return m.select("run", "block", F.size("loss_per_step").cast("long").alias("n_steps"), shown.alias("entries"))


def q_resume_merge(spark, sf):
    """A history up to half of each run, and a resumed run that repeats
    its last quarter before it goes on."""
    st = steps(spark, sf).select("run", "step", "loss", "max_steps")
    history = st.where("step < max_steps div 2").select("run", "step", _r("loss"), F.lit("history").alias("origin"))
    fresh = st.where("step >= max_steps div 4").select("run", "step", _r("loss"), F.lit("fresh").alias("origin"))
    return TM.resume_merge(history, fresh, resume=True)


def q_leftover_records(spark, sf):
    """Records of a run's last, incomplete step, which no other query counts."""
    return TS.leftover_records(TS.dealt_records(read_table(spark, sf, "events"), TEL))


def q_loader_report(spark, sf):
    """B9 over the corpus and a data name that it does not hold."""
    return SH.loader_report(prepared_manifest(spark, sf), [DATA_NAME, "other"])


def q_ingest_order(spark, sf):
    """Order column at ingest, over a key that is no integer."""
    d = read_table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("name"))
    return CO.number_rows(d, ["name"]).select("doc_id", "name", "doc_ord")


QUERIES: Dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}




# -- scoring ------------------------------------------------------------------

def q_unigram_test_loss(spark, sf):
    """A supplied model (unigram log-probabilities fitted on the training
    targets) scores every test sequence in mapInPandas; mean over sequences."""
    from ..operators import scoring as SC

    counts = lm_counts(spark, sf)
    lp = SC.unigram_log_probs(counts, word_tokenizer(spark, sf).vocab_size)
    test = seqs(spark, sf, LM_N).where(F.col("split") == "testing")
    scored = SC.score_sequences(test, SC.unigram_scorer(lp))
    return scored.agg(F.count(F.lit(1)).alias("n_sequences"), F.round(F.avg("loss"), 6).alias("loss"))


def q_stage_scores(spark, sf):
    """J2 with training progress: a supplied model that differs by stage scores
    every sequence that the schedule reads, in mapInPandas; mean by stage."""
    from ..operators import scoring as SC

    lp = SC.unigram_log_probs(lm_counts(spark, sf), word_tokenizer(spark, sf).vocab_size)
    sched = BA.batch_schedule(SH.shard_catalog(prepared_manifest(spark, sf), "training"), LM_LOADER, SCHEDULE_ACCUM, SCHEDULE_STEPS)
    rows = BA.schedule_sequences(sched, LM_LOADER).select(
        "stage", "shard_id", "seq", ((F.col("step") + 1) / F.lit(float(SCHEDULE_STEPS))).alias("progress"))
    train = seqs(spark, sf, LM_N).where(F.col("split") == "training").select("shard_id", "seq", "x", "y")
    scored = SC.score_sequences(rows.join(train, ["shard_id", "seq"]), SC.staged_scorer(lp), ("stage",), progress_col="progress")
    return scored.groupBy("stage").agg(F.count(F.lit(1)).alias("n_sequences"), F.round(F.avg("loss"), 6).alias("loss"))


def q_accumulation_steps(spark, sf):
    """B11 as a report: for ranks and batch sizes, whether the tokens of an
    optimiser step divide into micro batches, how many, and the steps that one
    round of the training split gives."""
    train = SH.shard_catalog(prepared_manifest(spark, sf), "training")
    shapes = [C.WindowSpec(B=b, T=SEQ_T, N=LM_N, W=w) for b in ACCUM_B for w in ACCUM_W]
    return reduce(DataFrame.unionByName, [BA.accumulation_report(train, spec, ACCUM_TOKENS) for spec in shapes])


def q_ratio_report(spark, sf):
    """B7 as a report: split ratios that add up to ten and what they make of
    the corpus; those that do not are refused."""
    return PK.ratio_report(prepared_manifest(spark, sf), REPORT_RATIOS)


def test_manifest(spark, sf) -> DataFrame:
    return SH.shard_catalog(prepared_manifest(spark, sf), "testing")


def whole_test_steps(spark, sf) -> int:
    """Loader calls after which each rank has read all its test batches and has come round."""
    rounds = BA.batches_per_rank(test_manifest(spark, sf), LM_LOADER).groupBy("rank").agg(F.sum("K").alias("M"))
    return (rounds.agg(F.max("M")).first()[0] or 0) + WHOLE_EXTRA


def test_losses(spark, sf, steps: int = TEST_STEPS) -> DataFrame:
    from ..operators import scoring as SC

    counts = lm_counts(spark, sf)
    test = seqs(spark, sf, LM_N).where(F.col("split") == "testing")
    return _prepared(spark, sf, f"test-losses-{steps}", lambda: SC.test_batch_losses(
        test, test_manifest(spark, sf), counts, LM_LOADER, word_tokenizer(spark, sf).vocab_size, steps))


def whole_test_loss(spark, sf) -> DataFrame:
    """``(run, test_loss)`` over the whole testing split, unrounded: as many
    loader calls as the longest round of a rank in the manifest, and
    ``WHOLE_EXTRA`` more, averaged over ranks (B=2, T=128, N=1, W=2)."""
    from ..operators import scoring as SC

    test = seqs(spark, sf, LM_N).where(F.col("split") == "testing")
    ranks = _prepared(spark, sf, "test-rank-losses", lambda: SC.test_rank_losses(
        test, test_manifest(spark, sf), lm_counts(spark, sf), LM_LOADER,
        word_tokenizer(spark, sf).vocab_size, whole_test_steps(spark, sf)))
    return ranks.groupBy("run").agg(F.avg("loss").alias("test_loss"))


def q_test_loss(spark, sf):
    """D7 + D4: count-model loss over the whole testing split, going round it."""
    return whole_test_loss(spark, sf).select("run", _r("test_loss"))


def q_test_loss_whole(spark, sf):
    """``test_loss`` under the name that it had while ``test_loss`` read a
    fixed number of loader calls."""
    return q_test_loss(spark, sf)


def q_horizon_counts(spark, sf):
    """H10 + C1 + D9 at the compressing model's horizon (4**3 = 64 tokens)."""
    from ..functions.schedules import horizon

    train = WI.sequences(packed_shards(spark, sf), SEQ_T, horizon()).where(F.col("split") == "training")
    return CM.next_token_counts(train)


def log_lines(spark, sf) -> DataFrame:
    """``(log_file, run, step, max_steps, value)``: step lines and the log file
    each run writes them to (H11 + H12)."""
    tel = telemetry(spark, sf)
    names = tel.groupBy("run").agg(F.min("ts").alias("t0")).select(
        "run", TS.log_file_name(F.col("run"), F.col("t0")).alias("log_file"))
    table = steps(spark, sf)
    lines = TM.step_log_lines(table).join(table.select("run", "step", "t0", "max_steps"), ["run", "step"]).join(names, "run")
    return lines.select("log_file", "run", "step", "max_steps", TS.log_line(F.col("t0"), F.col("line")).alias("value"))


def written_logs(spark, sf) -> str:
    """Step lines as log files named per run (H11 + H12)."""
    path = staging_path(spark, "logs")
    TS.write_training_logs(log_lines(spark, sf).select("log_file", "value"), path)
    return path


def q_generate_horizon(spark, sf):
    """J3 + H10: text made 64 tokens a pass from the counts at horizon 64."""
    from ..functions.schedules import horizon

    tok = word_tokenizer(spark, sf)
    counts = _prepared(spark, sf, "horizon-counts", lambda: q_horizon_counts(spark, sf))
    prompts = GE.prompt_matrix(prompt_tokens(spark, sf), [GEN_RUN])
    g = GE.generate(prompts, CM.topk_next(counts), CM.backoff_topk(counts), HORIZON_LENGTH, tok.vocab_size, horizon=horizon())
    return g.select("run", "item_id", _txt("tokens").alias("tokens_text"))


def q_log_scan(spark, sf):
    """A8 + H11 + H12: step lines written as log files, scanned back; the run
    comes from the file name."""
    return TS.read_training_logs(spark, written_logs(spark, sf)).drop("norm")


def q_log_report(spark, sf):
    """Lines, steps read and step lines that could not be read, per run."""
    return TS.step_line_report(TS.read_log_lines(spark, written_logs(spark, sf)))


def q_generate_ngram(spark, sf):
    """J3 by joins: all open prompts take a step together, by the longest of
    the contexts of two, one and no tokens that the model knows."""
    from ..operators import stepwise as SW

    model = _prepared(spark, sf, "ngram-successors", lambda: SW.successors(ngram_targets(spark, sf, "training"), NGRAM))
    prompts = GE.prompt_matrix(prompt_tokens(spark, sf), [GEN_RUN])
    g = SW.generate_by_joins(prompts, model, NGRAM, STEPWISE_LENGTH)
    return g.select("run", "item_id", _txt("tokens").alias("tokens_text"))


def q_step_documents(spark, sf):
    """C3 + E2 turned round: the documents each step and rank read, and how
    many tokens of each."""
    from ..operators.readback import step_documents

    sched = BA.batch_schedule(SH.shard_catalog(prepared_manifest(spark, sf), "training"), LOADER, SCHEDULE_ACCUM, SCHEDULE_STEPS)
    return step_documents(sched, PK.fragment_spans(prepared_offsets(spark, sf), SHARD_TOKENS), LOADER)


# -- streaming (run to completion with availableNow, output read back) --------

STREAM_BATCHES = 4
STOP_AFTER = 2                     # micro-batches before the stopped stream fails
STREAM_FILE_BYTES = 4 << 20        # of a part's bytes, as the planner estimates them, in each of its files; a file is one task's


def _arriving(spark, rows: DataFrame, order_col: str, name: str, file_bytes: int = STREAM_FILE_BYTES):
    """A file source to which ``rows`` came in ``STREAM_BATCHES`` parts, in the
    order of ``order_col``, read one part a micro-batch.  Each part has the
    same number of files, by the planner's estimate of the bytes (an empty
    file where Spark wrote fewer).  Rows without an order key come first, so
    that the reader of the stream meets them."""
    path = staging_path(spark, name)
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    files = max(1, min(-(-size // (STREAM_BATCHES * file_bytes)), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = rows.agg(*[F.expr(f"percentile_approx({order_col}, {k / STREAM_BATCHES})").alias(f"c{k}") for k in range(1, STREAM_BATCHES)]).first()
    above = [F.when(F.col(order_col) > F.lit(c), 1).otherwise(0) for c in cuts]
    part = sum(above[1:], above[0])
    none = spark.createDataFrame([], rows.schema).coalesce(1)
    for k in range(STREAM_BATCHES):
        of_part = rows.where(part == k)
        (of_part.coalesce(1) if files == 1 else of_part.repartition(files)).write.mode("append").parquet(path)
        for _ in range(files * (k + 1) - _parquet_files(spark, path)):
            none.write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def _parquet_files(spark, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return sum(f.getPath().getName().endswith(".parquet") for f in found)


def stream_packed(spark, sf) -> str:
    """I1 + I3: documents arriving in several files, packed batch by batch."""
    from ..streaming.packing import start_incremental_packing

    stream = _arriving(spark, docs(spark, sf), "doc_ord", "stream-docs")
    out, ck = staging_path(spark, "stream-pack"), staging_path(spark, "stream-pack-ck")
    start_incremental_packing(stream, out, ck, word_tokenizer(spark, sf), PACK, ratio=RATIO).awaitTermination()
    return out


def q_stream_pack_shards(spark, sf):
    from ..streaming.packing import read_packed

    f = read_packed(spark, stream_packed(spark, sf))
    return f.select("source_ord", "doc_ord", "shard_id", "pos",
                    F.size("tokens").cast("long").alias("length"), _txt("tokens").alias("tokens_text"))


def q_stream_resume(spark, sf):
    """The packing stream fails inside its third micro-batch, after the
    data and before the ledger, and a new start goes on from there."""
    from pyspark.errors import StreamingQueryException

    from ..streaming import packing as SP

    stream = _arriving(spark, docs(spark, sf), "doc_ord", "resume-docs")
    out, ck = staging_path(spark, "resume-pack"), staging_path(spark, "resume-pack-ck")
    tok = word_tokenizer(spark, sf)
    try:
        SP.start_incremental_packing(stream, out, ck, tok, PACK, ratio=RATIO, stop_before_ledger=STOP_AFTER).awaitTermination()
    except StreamingQueryException as e:
        if SP.STOPPED not in str(e):
            raise
    SP.start_incremental_packing(stream, out, ck, tok, PACK, ratio=RATIO).awaitTermination()
    f = SP.read_packed(spark, out)
    return f.select("source_ord", "doc_ord", "shard_id", "pos", F.size("tokens").cast("long").alias("length"), _txt("tokens").alias("tokens_text"))


def q_stream_manifest(spark, sf):
    from ..streaming.packing import read_stream_manifest

    m = read_stream_manifest(spark, stream_packed(spark, sf), PACK, RATIO)
    return m.select("data_name", "shard_id", "shard_name", "n_tokens", "n_docs", "split", "file_name")


def live_steps(spark, sf) -> DataFrame:
    """Completed steps of a telemetry record stream of several
    micro-batches, written once for the queries that read them."""
    from ..streaming.telemetry import completed_steps, start_live_step_loss

    def build():
        tel = telemetry(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
        out, ck = staging_path(spark, "live-loss"), staging_path(spark, "live-loss-ck")
        start_live_step_loss(_arriving(spark, tel, "step", "live-records"), out, ck, TEL).awaitTermination()
        return completed_steps(spark, out, TEL)

    return _prepared(spark, sf, "live-steps", build)


def q_live_step_loss(spark, sf):
    """Step loss of completed steps, from records as they arrive."""
    return live_steps(spark, sf).select("run", "step", _r("loss"))


def q_live_throughput(spark, sf):
    """I2 + D8: duration and throughput of completed steps, from records as they arrive."""
    return live_steps(spark, sf).select("run", "step", "dt_ms", _r("tok_per_sec", 4))


LOG_PARTS = 3                      # states of the growing log files


def _log_part(lines: DataFrame, part: int) -> DataFrame:
    """``(log_file, ord, text)``: what a run has logged when ``part`` of
    ``LOG_PARTS`` of its steps are done, the next line half written."""
    done = F.expr(f"max_steps * {part} div {LOG_PARTS}")
    half = F.expr("substr(value, 1, length(value) div 2)")
    text = F.when(F.col("step") < done, F.concat("value", F.lit("\n"))).otherwise(half)
    return lines.where(F.col("step") <= done).select("log_file", F.col("step").alias("ord"), text.alias("text"))


def q_live_log_steps(spark, sf):
    """A8 + I2: one log file a run that grows in ``LOG_PARTS`` parts, each cut
    inside a line; a stream reads what it has gained, stops, and goes on."""
    from ..sources import livelogs as LL

    lines = stage_table(log_lines(spark, sf), "log-lines")
    path, out, ck = (staging_path(spark, f"live-logs{x}") for x in ("", "-out", "-ck"))
    for part in range(1, LOG_PARTS + 1):
        TS.write_log_files(_log_part(lines, part), path)
        stream = LL.live_log_steps(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
        stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("norm")


# -- flat shard files -----------------------------------------------------------

NPY_CHUNK = 1000                   # tokens of a row read from a flat shard


def q_npy_shard_scan(spark, sf):
    """A2 + A3: every shard written as a flat 16-bit file that the reference's
    loader reads, the training split read back by byte ranges."""
    from ..sources import npy as NP

    path = staging_path(spark, "npy")
    NP.write_npy_shards(packed_shards(spark, sf), prepared_manifest(spark, sf), path)
    back = NP.read_npy_shards(spark, path, "training", DATA_NAME, NPY_CHUNK, "long")
    return back.select("data_name", "split", "shard_id", "pos", F.size("tokens").cast("long").alias("length"), _txt("tokens").alias("tokens_text"))


# -- longer contexts --------------------------------------------------------------

NGRAM = 3
STEPWISE_LENGTH = 32               # tokens to which the joins grow a prompt


def ngram_targets(spark, sf, split: str) -> DataFrame:
    """Contexts of ``NGRAM`` - 1 tokens and targets of a split, counted; one pass for all splits, written once."""
    from ..operators import ngram as NG

    both = _prepared(spark, sf, "ngram-targets", lambda: NG.target_counts(seqs(spark, sf, LM_N), NGRAM, ("split",)))
    return both.where(F.col("split") == split).drop("split")


def q_ngram_counts(spark, sf):
    """D9 over contexts of two, one and no tokens: counts, and continuation counts below."""
    from ..operators import ngram as NG

    return NG.ngram_counts(ngram_targets(spark, sf, "training"), NGRAM)


def q_ngram_cross_entropy(spark, sf):
    """D10 of the interpolated backoff model."""
    from ..operators import ngram as NG

    ce = NG.cross_entropy(ngram_targets(spark, sf, "testing"), ngram_targets(spark, sf, "training"), NGRAM, word_tokenizer(spark, sf).vocab_size)
    return ce.select("n_targets", _r("cross_entropy"))


QUERIES.update({"stream_pack_shards": q_stream_pack_shards, "stream_manifest": q_stream_manifest,
                "live_step_loss": q_live_step_loss, "live_throughput": q_live_throughput, "live_log_steps": q_live_log_steps,
                "npy_shard_scan": q_npy_shard_scan, "ngram_counts": q_ngram_counts, "ngram_cross_entropy": q_ngram_cross_entropy,
                "stage_scores": q_stage_scores, "accumulation_steps": q_accumulation_steps, "ratio_report": q_ratio_report,
                "stream_resume": q_stream_resume, "generate_ngram": q_generate_ngram, "step_documents": q_step_documents,
                "log_report": q_log_report, "topk_bounded": q_topk_bounded, "curve_pixels": q_curve_pixels,
                "unigram_test_loss": q_unigram_test_loss, "test_loss": q_test_loss,
                "test_loss_whole": q_test_loss_whole,
                "horizon_counts": q_horizon_counts, "generate_horizon": q_generate_horizon, "log_scan": q_log_scan})
