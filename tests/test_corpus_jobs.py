"""End-to-end jobs: prepare -> load -> train -> evaluate -> generate equals the
in-memory operator chain, and the loader checks fire."""

import os

import pytest
from pyspark.sql import functions as F

from shardloom.config import DatasetSpec, PackSpec, SplitRatio, WindowSpec
from shardloom.operators import countmodel as CM
from shardloom.operators.packing import label_splits, pack_fragments
from shardloom.operators.tokenize import WordTokenizer
from shardloom.operators.windows import sequences
from shardloom.plans.corpus import (corpus_documents, evaluate, generate_responses, load_split,
                                    prepare_corpus, train_count_model)

from conftest import SF_SMALL


def test_prepare_load_train_evaluate(spark, tmp_dir):
    datasets = [DatasetSpec(path=f"{SF_SMALL}/documents.parquet", data_keys=["text"], order_col="doc_id")]
    pack = PackSpec("docs", shard_tokens=4000, ranges=32)
    out = f"{tmp_dir}/shards"
    man = prepare_corpus(spark, datasets, out, "word", pack, SplitRatio(8, 1, 1))
    assert man.count() == 20
    docs = corpus_documents(spark, datasets)
    tok = WordTokenizer.fit(docs)
    mem = label_splits(pack_fragments(docs, tok, pack), SplitRatio(8, 1, 1))
    key = lambda r: (r.shard_id, r.pos, tuple(r.tokens))
    assert sorted(map(key, load_split(spark, out, "training").collect())) == \
        sorted(map(key, mem.where("split = 'training'").collect()))
    spec = WindowSpec(B=2, T=32, N=1, W=1)
    counts = train_count_model(spark, out, spec, f"{tmp_dir}/model")
    want = CM.next_token_counts(sequences(mem.where("split = 'training'"), 32, 1))
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect()))
    ce = evaluate(spark, out, counts, spec, tok.vocab_size).collect()[0]
    assert ce.n_targets > 0 and 0 < ce.cross_entropy < 20
    prompts = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").limit(3)
    resp = generate_responses(prompts, tok, counts, ["m1"], 24).collect()
    assert len(resp) == 3 and all(r.m1 for r in resp)


def test_empty_split_raises(spark, tmp_dir):
    datasets = [DatasetSpec(path=f"{SF_SMALL}/documents.parquet", data_keys=["text"], order_col="doc_id")]
    with pytest.raises(ValueError, match="no shards"):
        prepare_corpus(spark, datasets, f"{tmp_dir}/few", "bytes", PackSpec("b", shard_tokens=10_000_000))
    assert not os.path.exists(f"{tmp_dir}/few")          # checked before anything is written
    man = prepare_corpus(spark, datasets, f"{tmp_dir}/few2", "bytes", PackSpec("b", shard_tokens=10_000_000),
                         allow_empty_split=True)
    assert [r.split for r in man.collect()] == ["training"]
    with pytest.raises(ValueError, match="testing"):
        load_split(spark, f"{tmp_dir}/few2", "testing")


def test_command_line(spark, tmp_dir):
    from shardloom.__main__ import main
    out, model, resp = f"{tmp_dir}/cli", f"{tmp_dir}/cli_model", f"{tmp_dir}/cli_resp"
    assert main(["prepare", "--dataset", f"{SF_SMALL}/documents.parquet", "--keys", "text", "--order", "doc_id",
                 "--out", out, "--shard-tokens", "4000", "--split", "8,1,1"], spark) == 0
    assert main(["train", "--shards", out, "--model", model, "--B", "2", "--T", "32"], spark) == 0
    assert main(["test", "--shards", out, "--model", model, "--B", "2", "--T", "32"], spark) == 0
    assert main(["generate", "--shards", out, "--model", model, "--prompts", f"{SF_SMALL}/benchmark.parquet",
                 "--max-length", "20", "--out", resp], spark) == 0
    rows = spark.read.parquet(resp).collect()
    assert len(rows) == spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").count()
    assert all(r["count-model"] for r in rows)
    with pytest.raises(SystemExit):
        main(["prepare", "--dataset", "x", "--keys", "text", "--out", out, "--split", "8,1"], spark)


def test_bytes_corpus_and_two_names_in_a_store(spark, tmp_dir):
    """Test and generate for a bytes corpus numbered at ingest; a second data
    name leaves the first alone; re-splitting moves shards between splits."""
    from shardloom.__main__ import main
    out, model, resp = f"{tmp_dir}/bytes", f"{tmp_dir}/bytes_model", f"{tmp_dir}/bytes_resp"
    prepare = ["prepare", "--dataset", f"{SF_SMALL}/documents.parquet", "--keys", "text", "--out", out, "--tokenizer", "bytes",
               "--shard-tokens", "30000"]
    assert main([*prepare, "--data-name", "one"], spark) == 0
    first = sorted(map(str, load_split(spark, out, "training").collect()))
    assert main([*prepare, "--data-name", "two", "--where", "lang = 'en'"], spark) == 0
    with pytest.raises(ValueError):
        load_split(spark, out, "training")
    assert sorted(map(str, load_split(spark, out, "training", "one").collect())) == first
    with pytest.raises(ValueError):
        load_split(spark, out, "training", "three")
    assert main(["train", "--shards", out, "--model", model, "--B", "2", "--T", "32", "--data-name", "one"], spark) == 0
    assert main(["test", "--shards", out, "--model", model, "--B", "2", "--T", "32", "--data-name", "one"], spark) == 0
    assert main(["generate", "--shards", out, "--model", model, "--prompts", f"{SF_SMALL}/benchmark.parquet",
                 "--max-length", "20", "--out", resp], spark) == 0
    assert spark.read.parquet(resp).count() == spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").count()
    tokens = lambda: sum(len(r.tokens) for s in ("training", "validation", "testing") for r in load_split(spark, out, s, "one").collect())
    before = tokens()
    assert main(["resplit", "--shards", out, "--split", "5,3,2", "--data-name", "one"], spark) == 0
    assert tokens() == before
    assert all(r.shard_id % 10 < 5 for r in load_split(spark, out, "training", "one").select("shard_id").collect())


def test_numbering_at_ingest(spark, tmp_dir):
    from shardloom.sources.corpus import number_rows
    rows = [(f"k{(7 * i) % 50:02d}", i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i int").repartition(4)
    assert [r.k for r in number_rows(df, ["k"]).orderBy("doc_ord").collect()] == sorted(k for k, _ in rows)
    for part in (rows[:20], rows[20:]):
        spark.createDataFrame(part, "k string, i int").coalesce(1).write.mode("append").parquet(f"{tmp_dir}/files")
    got = number_rows(spark.read.parquet(f"{tmp_dir}/files")).orderBy("doc_ord").collect()
    assert [r.doc_ord for r in got] == list(range(50))
    order = [r.i for r in got]
    assert order in (list(range(50)), list(range(20, 50)) + list(range(20)))     # files by name, rows as they stand


def test_command_line_curves(spark, tmp_dir):
    from shardloom.__main__ import main
    from shardloom.plans import queries as Q
    from shardloom.sources.telemetry import log_file_name, log_line, write_training_logs
    from shardloom.operators.telemetry import step_duration, step_log_lines, step_table
    tel = Q.telemetry(spark, SF_SMALL)
    names = tel.groupBy("run").agg(F.min("ts").alias("t0")).select(
        "run", log_file_name(F.col("run"), F.col("t0")).alias("log_file"))
    starts = step_duration(tel).select("run", "step", "t0")
    lines = step_log_lines(step_table(tel, Q.TEL)).join(starts, ["run", "step"]).join(names, "run")
    write_training_logs(lines.select("log_file", log_line(F.col("t0"), F.col("line")).alias("value")),
                        f"{tmp_dir}/logs")
    assert main(["curves", "--logs", f"{tmp_dir}/logs", "--out", f"{tmp_dir}/curves"], spark) == 0
    got = {(r.run, r.step): r.loss for r in spark.read.parquet(f"{tmp_dir}/curves").collect()}
    want = {(r.run, r.step): round(r.loss, 6) for r in step_table(tel, Q.TEL).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_prepare_with_bpe_encodes_once_and_packs_exactly(spark, tmp_dir):
    import tiktoken
    from shardloom.operators.tokenize import BpeTokenizer, EOT_TEXT, GPT2_PATTERN
    ranks = {bytes([i]): i for i in range(256)}
    for pair in (b"th", b"the", b" the", b"in", b"er", b"an", b" a"):
        ranks[pair] = len(ranks)
    tok = BpeTokenizer(ranks, spark=spark)
    enc = tiktoken.Encoding("toy", pat_str=GPT2_PATTERN, mergeable_ranks=ranks,
                            special_tokens={EOT_TEXT: len(ranks)})
    datasets = [DatasetSpec(path=f"{SF_SMALL}/documents.parquet", data_keys=["text"], order_col="doc_id")]
    pack = PackSpec("bpe", shard_tokens=50_000, ranges=16)
    out = f"{tmp_dir}/bpe"
    prepare_corpus(spark, datasets, out, tok, pack, SplitRatio(8, 1, 1), allow_empty_split=True)
    texts = [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()]
    flat = []
    for t in texts:
        flat.append(len(ranks))
        flat.extend(enc.encode_ordinary(t))
    from shardloom.sources.shards import read_shards
    frags = read_shards(spark, out).collect()
    shards = {}
    for r in sorted(frags, key=lambda r: (r.shard_id, r.pos)):
        shards.setdefault(r.shard_id, []).extend(r.tokens)
    assert [t for k in sorted(shards) for t in shards[k]] == flat


def test_instruction_pairs_of_any_length(spark):
    """Turns beyond the usual stride widen it; bad turns and too wide keys fail."""
    from shardloom.sources.corpus import TURN_STRIDE, instruction_pairs

    schema = "conv_id long, turn int, role string, text string"

    def pairs(rows, **given):
        made = instruction_pairs(spark.createDataFrame(rows, schema), **given)
        return [(r.doc_ord, r.instruction, r.output) for r in made.orderBy("doc_ord").collect()]

    short = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 3, "user", "c"), (2, 4, "assistant", "d"), (2, 5, "user", "e"), (2, 7, "assistant", "f")]
    assert pairs(short) == [(TURN_STRIDE, "a", "b"), (2 * TURN_STRIDE + 3, "c", "d")]
    late = TURN_STRIDE + 10
    long = short + [(1, late, "user", "g"), (1, late + 1, "assistant", "h")]
    assert pairs(long) == [(late + 2, "a", "b"), (2 * late + 2, "g", "h"), (2 * (late + 2) + 3, "c", "d")]
    assert pairs([]) == [] and pairs([(1, None, "user", "a"), (None, 1, "assistant", "b")]) == []
    for rows, given, message in ((long, {"max_turns": 100}, "out of range"), ([(1, -2, "user", "a"), (1, -1, "assistant", "b")], {}, "out of range"),
                                 ([(1 << 50, 0, "user", "a"), (1 << 50, 1, "assistant", "b")], {}, "63 bits")):
        with pytest.raises(Exception, match=message):
            pairs(rows, **given)
