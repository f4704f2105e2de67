"""Tokenizer modes against direct Python / library calls; failure cases."""

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from shardloom.config import BYTE_EOT_ID, DatasetSpec, SplitRatio
from shardloom.operators.tokenize import (BpeTokenizer, ByteTokenizer, WordTokenizer, check_token_range,
                                          token_range_report, tokenize_documents, widen)
from shardloom.sources.corpus import documents, join_keys

TEXTS = ["hello world", "", "  two  spaces ", "tabs\tand\nnewlines", "accents é and emoji 🙂",
         "special <|endoftext|> text", "trailing "]


def df_of(spark, texts):
    return spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)],
                                 "source_ord int, doc_ord long, text string")


def test_bytes_mode_exact(spark):
    tok = ByteTokenizer(spark)
    rows = tokenize_documents(df_of(spark, TEXTS), tok).orderBy("doc_ord").collect()
    for r, t in zip(rows, TEXTS):
        assert list(r.tokens) == [BYTE_EOT_ID] + list(t.encode("utf-8"))
        assert r.n == len(t.encode("utf-8")) + 1
    back = df_of(spark, TEXTS).select(tok.decode(tok.encode(F.col("text"), eot=False)).alias("t")).collect()
    assert [r.t for r in back] == TEXTS


def test_word_mode_ranks_and_lookup(spark):
    docs = df_of(spark, ["b a b", "c b a", "d"])
    tok = WordTokenizer.fit(docs, cap=2)
    assert tok.words == ["b", "a"]            # b:3, a:2, then c/d cut by the cap
    rows = tokenize_documents(docs, tok).orderBy("doc_ord").collect()
    eot = tok.eot_id
    spelled = lambda w: [0] + [eot + 1 + b for b in w.encode()]
    assert [list(r.tokens) for r in rows] == [[eot, 1, 2, 1], [eot, *spelled("c"), 1, 2], [eot, *spelled("d")]]
    counts = docs.select(tok.count(F.col("text")).alias("n")).collect()
    assert [r.n for r in counts] == [4, 5, 3]
    dec = docs.select(tok.decode(tok.encode(F.col("text"), eot=False)).alias("t")).collect()
    assert [r.t for r in dec] == ["b a b", "c b a", "d"]


def test_word_mode_loses_nothing(spark):
    docs = df_of(spark, TEXTS + ["é日本 \n x", "zz " * 50])
    tok = WordTokenizer.fit(df_of(spark, ["hello a"]), cap=2)
    back = docs.select("text", tok.decode(tok.encode(F.col("text"), eot=False)).alias("t")).collect()
    assert all(r.t == r.text for r in back)
    # sequences that no text has: bytes that are no UTF-8, bytes without their mark
    odd = spark.createDataFrame([([0, tok.byte_base + 255, 1],), ([1, tok.byte_base + 65, 0, 0],), ([],), (None,)], "ids array<int>")
    assert [r.t for r in odd.select(tok.decode(F.col("ids")).alias("t")).collect()] == [f"<0xFF> {tok.words[0]}", f"{tok.words[0]} A  ", "", None]


def test_word_mode_matches_python_split(spark):
    docs = df_of(spark, TEXTS)
    tok = WordTokenizer.fit(docs)
    ids = {w: i + 1 for i, w in enumerate(tok.words)}
    rows = tokenize_documents(docs, tok).orderBy("doc_ord").collect()
    for r, t in zip(rows, TEXTS):
        assert list(r.tokens) == [tok.eot_id] + [ids.get(w, 0) for w in t.split(" ")]


def _toy_ranks():
    ranks = {bytes([i]): i for i in range(256)}
    for pair in (b"he", b"ll", b"hell", b"hello", b" w", b"or"):
        ranks[pair] = len(ranks)
    return ranks


def test_bpe_mode_equals_library(spark):
    import tiktoken
    from shardloom.operators.tokenize import GPT2_PATTERN, EOT_TEXT

    ranks = _toy_ranks()
    tok = BpeTokenizer(ranks, spark=spark)
    enc = tiktoken.Encoding("toy", pat_str=GPT2_PATTERN, mergeable_ranks=ranks,
                            special_tokens={EOT_TEXT: len(ranks)})
    rows = tokenize_documents(df_of(spark, TEXTS), tok).orderBy("doc_ord").collect()
    for r, t in zip(rows, TEXTS):
        assert list(r.tokens) == [len(ranks)] + enc.encode_ordinary(t)   # special text stays plain
    dec = df_of(spark, TEXTS).select(tok.decode(tok.encode(F.col("text"), eot=False)).alias("t")).collect()
    assert [r.t for r in dec] == TEXTS


def test_token_range(spark):
    df = spark.createDataFrame([([1, 2],), ([70000, -1, 3],)], "tokens array<int>")
    rep = token_range_report(df).collect()[0]
    assert (rep.n_docs, rep.n_tokens, rep.n_bad_docs, rep.n_bad_tokens) == (2, 5, 1, 2)
    with pytest.raises(Exception, match="outside 0"):
        check_token_range(df).collect()
    assert df.select(widen(F.col("tokens"), "long").alias("t")).schema["t"].dataType.simpleString() == "array<bigint>"
    with pytest.raises(ValueError):
        widen(F.col("tokens"), "short")


def test_null_field_raises_or_drops(spark, tmp_dir):
    path = f"{tmp_dir}/d"
    spark.createDataFrame([(1, "a", "b"), (2, None, "c")], "id long, instruction string, output string") \
        .write.parquet(path)
    spec = DatasetSpec(path=path, data_keys=["instruction", "output"], order_col="id")
    with pytest.raises(Exception, match="null text"):
        documents(spark, spec).collect()
    kept = documents(spark, spec, on_null="drop").collect()
    assert [(r.doc_ord, r.text) for r in kept] == [(1, "a b")]
    bad = DatasetSpec(path=path, data_keys=["missing"], order_col="id")
    with pytest.raises(AnalysisException):
        documents(spark, bad).collect()


def test_join_keys_keeps_null_not_skips(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert df.select(join_keys(["x", "y"]).alias("t")).collect()[0].t is None


def test_split_ratio_must_sum_to_ten():
    with pytest.raises(ValueError):
        SplitRatio(7, 1, 1)
    SplitRatio(6, 2, 2)


def test_word_encoding_is_the_same_in_small_slices(spark, monkeypatch):
    from shardloom.operators import tokenize as TK

    texts = ["", "a b  c", "long " * 50 + "ñandú", None, "zz", " "] * 3
    monkeypatch.setattr(TK, "SLICE_BYTES", 10)
    parts = list(TK._slices(pa.array(texts)))
    assert [t for p in parts for t in p.to_pylist()] == texts and len(parts) > 3
    monkeypatch.undo()
    tok = WordTokenizer(spark, ["a", "b"])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").coalesce(1)
    rows = df.select("t", tok.encode(df.t, eot=False).alias("ids"), tok.decode(tok.encode(df.t, eot=False)).alias("back")).collect()
    assert all(r.back == r.t for r in rows)


def test_decoding_holds_the_integers_of_a_row_and_not_of_a_batch(spark):
    import tracemalloc

    tok = WordTokenizer(spark, [f"w{k}" for k in range(2000)])
    decode = tok._decode_udf.func
    ids = pa.array([list(range(1001, 1501))] * 4000 + [None], pa.list_(pa.int32()))
    want = " ".join(f"w{k}" for k in range(1000, 1500))
    decode(ids[:1])
    tracemalloc.start()
    got = decode(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0].as_py() == want and got[3999].as_py() == want and not got[4000].is_valid
    assert peak < 4 * 4000 * len(want)  # the texts are 12 MB, the batch's ids as integers more than 70 MB
