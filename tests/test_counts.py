"""Counts of pairs and words made within tasks: the same as counting row by row, and no row for an occurrence."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from shardloom import config as C
from shardloom.operators import countmodel as CM
from shardloom.operators import scoring as SC
from shardloom.operators.tokenize import TOKENS_TYPE, WordTokenizer, check_token_range

SCHEMA = "split string, rank int, x array<int>, y array<int>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def counted(rows, of):
    return Counter(k for r in rows for k in of(r))


@pytest.mark.parametrize("top", [5, (1 << 24) + 3])
def test_pair_counts_by_keys(spark, top):
    rows = [("a" if i % 3 else None, i % 2, [i % top, 7, top], [3, top, i % 4]) for i in range(50)] + [("b", 0, [], []), ("b", 1, [-1], [None])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = counted(rows, lambda r: [(r[0], r[1], a, b) for a, b in zip(r[2], r[3])])
    got = CM.pair_counts(df, "split", "rank").collect()
    assert {tuple(r)[:4]: r.c for r in got} == want and len(got) == len(want)
    want = counted(rows, lambda r: list(zip(r[2], r[3])))
    got = CM.next_token_counts(df).collect()
    assert {(r.a, r.b): r.c for r in got} == want and len(got) == len(want)


def test_pair_counts_of_more_than_a_task_counts_at_once(spark):
    n = CM.TARGETS_AT_ONCE // 100
    x = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda j: ((F.col("id") % 7) * j % 1000).cast("int"))
    df = spark.range(0, n, 1, 1).select(F.when(F.col("id") % 2 == 0, "testing").otherwise("training").alias("split"), x.alias("x"), x.alias("y"))
    got = CM.split_pair_counts(df).collect()
    assert len({(r.split, r.a, r.b) for r in got}) == len(got)
    assert sum(r.c for r in got) == n * 256
    want = counted([(i % 2, i % 7) for i in range(n)], lambda r: [r])
    twos = sum(want[0, k] * sum(k * j % 1000 == 2 for j in range(256)) for k in range(7))
    assert [r.c for r in got if (r.split, r.a) == ("testing", 2)] == [twos]


def test_pair_counts_of_nothing(spark):
    assert CM.split_pair_counts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_uneven_sequences_fail(spark):
    with pytest.raises(Exception, match="differ in length"):
        CM.next_token_counts(spark.createDataFrame([("a", 0, [1, 2], [1])], SCHEMA)).collect()


def test_no_row_for_a_target(spark):
    df = spark.createDataFrame([("a", 0, [1, 2], [2, 3])], SCHEMA)
    assert "Generate" not in plan(CM.split_pair_counts(df))
    assert "Generate" not in plan(CM.next_token_counts(df))
    seqs = df.select("split", F.lit(0).alias("shard_id"), F.lit(0).alias("seq"), "x", "y")
    manifest = spark.createDataFrame([(0, 3)], "shard_id int, n_tokens long")
    spec = C.WindowSpec(B=1, T=2, N=1, W=1)
    losses = SC.test_rank_losses(seqs, manifest, CM.next_token_counts(df), spec, 10, 3)
    assert "posexplode" not in plan(losses)
    assert losses.count() == 1


def test_word_counts(spark):
    texts = ["a b a", "", " a  b", "c" * 50, "a\tb é"] * 40
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(2)
    words = WordTokenizer.word_counts(df)
    got = words.collect()
    assert {r["word"]: r["count"] for r in got} == counted(texts, lambda t: t.split(" "))
    assert len({r["word"] for r in got}) == len(got)
    assert "Generate" not in plan(words)


@pytest.mark.parametrize("tokens, ok", [([], True), ([0, 9], True), ([10], False), ([3, -1], False), (None, False)])
def test_token_range_in_compiled_code(spark, tokens, ok):
    from pyspark.sql import types as T

    df = check_token_range(spark.createDataFrame([(tokens,)], T.StructType([T.StructField("tokens", TOKENS_TYPE)])), limit=10)
    assert "forall" not in plan(df)
    if ok:
        assert df.first().tokens == tokens
    else:
        with pytest.raises(Exception, match="token id outside 0 .. 9"):
            df.collect()
