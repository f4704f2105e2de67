"""Prompt preparation (H3, H4, H5), runs x prompts (C2), seeded top-k
generation (J3, with C5 gather, H7 append, G4 limit) and responses side by
side (J4).

Generation is sequential per prompt, so it runs in ``mapInPandas``: Spark
partitions the prompt rows across tasks and each task walks its own prompts.
The model it reads is the top-k table (at most ``k * vocab_size`` rows, a
bound fixed by the capped vocabulary, checked before it is broadcast).
The draw for a step is ``md5(seed|run|item|length)`` read as a 32-bit
uniform, so results do not depend on partitioning or task order; the pick
compares ``u * total < cumulative * 2**32`` in exact integers.
"""

from __future__ import annotations

import hashlib
from typing import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import GENERATION_SEED, TOKEN_LIMIT, TOP_K
from ..session import ship_package


def tail_context(tokens: Column, size: int) -> Column:
    """H5: keep the last ``size`` tokens when longer (causal models)."""
    return F.when(F.size(tokens) > size, F.slice(tokens, -size, size)).otherwise(tokens)


def head_context(tokens: Column, size: int) -> Column:
    """H4: keep the first ``size`` tokens (the compressing model)."""
    return F.slice(tokens, 1, size)


def left_pad(tokens: Column, size: int, pad_id: int | Column) -> Column:
    """H3: left-pad with ``pad_id`` (the space token) up to ``size``."""
    pad = pad_id if isinstance(pad_id, Column) else F.lit(pad_id)
    missing = F.greatest(F.lit(0), F.lit(size) - F.size(tokens))
    return F.concat(F.array_repeat(pad, missing), tokens)


def prepare_prompts(tokens: Column, size: int, pad_id: int | Column) -> Column:
    """H3 + H4: head-truncate then left-pad to exactly ``size`` tokens."""
    return left_pad(head_context(tokens, size), size, pad_id)


def prompt_matrix(prompts: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Every requested run with every prompt.  The run list is a driver
    config (the models to test), expanded by a generator, not a join."""
    if not runs:
        raise ValueError("no runs requested")
    return prompts.withColumn("run", F.explode(F.array(*[F.lit(r) for r in runs])))


def draw_u32(seed: int, run: str, item_id: int, step: int) -> int:
    msg = f"{seed}|{run}|{item_id}|{step}".encode()
    return int(hashlib.md5(msg).hexdigest()[:8], 16)


def pick_candidate(u: int, cands: Sequence[int], weights: Sequence[int]) -> int:
    """First candidate whose cumulative weight exceeds ``u/2**32 * total``;
    weights need not sum to one."""
    total = sum(weights)
    acc = 0
    for b, c in zip(cands, weights):
        acc += c
        if u * total < acc * (1 << 32):
            return b
    return cands[-1]


def _model_tables(topk: DataFrame, backoff: DataFrame, k: int, vocab_size: int):
    """The top-k table as Arrow, sorted by context and rank, after a count has
    shown that it keeps its bound of ``k * vocab_size`` rows."""
    bound = k * vocab_size
    if topk.count() > bound:
        raise ValueError("top-k table exceeds k * vocab_size rows")
    tab = topk.select("a", "rnk", "b", "c").toArrow().sort_by([("a", "ascending"), ("rnk", "ascending")])
    return tab, backoff.select("rnk", "b", "c").toArrow().sort_by("rnk")


def _successors(tab, back):
    """``{a: ([b...], [c...])}`` and the same of the backoff, from Arrow."""
    cols, rest, table = tab.to_pydict(), back.to_pydict(), {}
    for a, b, c in zip(cols["a"], cols["b"], cols["c"]):
        bs, cs = table.setdefault(a, ([], []))
        bs.append(b)
        cs.append(c)
    return table, (rest["b"], rest["c"])


def generate(prompts: DataFrame, topk: DataFrame, backoff: DataFrame, max_length: int,
             vocab_size: int, k: int = TOP_K, seed: int = GENERATION_SEED, horizon: int = 1) -> DataFrame:
    """``prompts(run, item_id, tokens)`` -> ``(run, item_id, tokens)`` grown
    until ``max_length``; a prompt not shorter than the limit is only cut (G4).

    A pass makes ``horizon`` tokens at once: each is drawn from what follows
    the token ``horizon`` places before it (``topk`` counted at that horizon),
    so none needs another of its pass.  With 1 that is a token at a time."""
    if not 0 < vocab_size <= TOKEN_LIMIT:
        raise ValueError("vocab_size must be in (0, 65536]")
    if horizon < 1:
        raise ValueError("horizon must be positive")
    spark = prompts.sparkSession
    ship_package(spark)
    bc = spark.sparkContext.broadcast(_model_tables(topk, backoff, k, vocab_size))
    limit = int(max_length)

    def run_partition(batches):
        model, fallback = _successors(*bc.value)
        for pdf in batches:
            out = []
            for run, item, toks in zip(pdf["run"], pdf["item_id"], pdf["tokens"]):
                seq = [int(t) for t in toks]
                while len(seq) < limit:
                    for at in range(len(seq), len(seq) + horizon):
                        bs, cs = (model.get(seq[at - horizon]) if at >= horizon else None) or fallback
                        seq.append(pick_candidate(draw_u32(seed, run, int(item), at), bs, cs))
                out.append(seq[:limit])
            yield pd.DataFrame({"run": pdf["run"], "item_id": pdf["item_id"], "tokens": out})

    schema = T.StructType([
        T.StructField("run", T.StringType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("tokens", T.ArrayType(T.IntegerType())),
    ])
    spread = prompts.select("run", F.col("item_id").cast("long"), "tokens").repartition("item_id", "run")
    return spread.mapInPandas(run_partition, schema)


def responses_pivot(responses: DataFrame, runs: Sequence[str], value: str = "response") -> DataFrame:
    """One row per prompt, one column per run (runs listed, so no extra
    pass to discover pivot values)."""
    return responses.groupBy("item_id").pivot("run", list(runs)).agg(F.first(value))
