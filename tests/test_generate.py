"""Generation: partition independence, cut-only long prompts, unseen-context
backoff, pick rule, prompt shaping functions."""

from pyspark.sql import functions as F

from shardloom.operators.generate import (draw_u32, generate, head_context, left_pad, pick_candidate,
                                          prepare_prompts, prompt_matrix, responses_pivot, tail_context)


def model(spark):
    counts = spark.createDataFrame([(1, 2, 5), (1, 3, 1), (2, 1, 4), (3, 1, 1), (3, 2, 2)], "a int, b int, c long")
    from shardloom.operators.countmodel import backoff_topk, topk_next
    return topk_next(counts), backoff_topk(counts)


def prompts(spark, parts):
    rows = [("m", i, [1, 2, 3][: (i % 3) + 1]) for i in range(20)] + [("m", 99, [7]), ("m", 100, [1] * 12)]
    return spark.createDataFrame(rows, "run string, item_id long, tokens array<int>").repartition(parts)


def test_partition_independent_and_limits(spark):
    topk, back = model(spark)
    a = {r.item_id: list(r.tokens) for r in generate(prompts(spark, 1), topk, back, 8, 10).collect()}
    b = {r.item_id: list(r.tokens) for r in generate(prompts(spark, 5), topk, back, 8, 10).collect()}
    assert a == b
    assert all(len(v) == 8 for v in a.values())
    assert a[100] == [1] * 8                      # prompt longer than the limit is only cut
    assert a[99][1] in (1, 2)                     # unseen context 7 backs off to frequent tokens


def test_pick_rule():
    assert pick_candidate(0, [5, 6], [1, 1]) == 5
    assert pick_candidate((1 << 32) - 1, [5, 6], [1, 1]) == 6
    assert pick_candidate((1 << 31) - 1, [5, 6, 7], [1, 1, 2]) == 6
    assert pick_candidate(1 << 31, [5, 6, 7], [1, 1, 2]) == 7
    assert 0 <= draw_u32(42, "m", 1, 3) < 1 << 32


def test_prompt_shaping(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([9],)], "t array<int>")
    rows = df.select(tail_context(F.col("t"), 3).alias("tail"), head_context(F.col("t"), 3).alias("head"),
                     left_pad(F.col("t"), 4, 0).alias("pad"), prepare_prompts(F.col("t"), 4, 0).alias("prep")).collect()
    assert list(rows[0].tail) == [3, 4, 5] and list(rows[1].tail) == [9]
    assert list(rows[0].head) == [1, 2, 3]
    assert list(rows[1].pad) == [0, 0, 0, 9] and list(rows[0].pad) == [1, 2, 3, 4, 5]
    assert list(rows[0].prep) == [1, 2, 3, 4]


def test_matrix_and_pivot(spark):
    p = spark.createDataFrame([(1,), (2,)], "item_id long")
    m = prompt_matrix(p, ["x", "y"]).withColumn("response", F.concat("run", F.col("item_id").cast("string")))
    rows = {r.item_id: (r.x, r.y) for r in responses_pivot(m, ["x", "y"]).collect()}
    assert rows == {1: ("x1", "y1"), 2: ("x2", "y2")}


def test_empty_prompt_backs_off(spark):
    topk, back = model(spark)
    p = spark.createDataFrame([("m", 1, [])], "run string, item_id long, tokens array<int>")
    out = generate(p, topk, back, 5, 10).collect()[0]
    assert len(out.tokens) == 5 and out.tokens[0] in (1, 2)
