"""J3 from a model that fits no task: step-synchronous generation as an iterative join.

``generate`` (see ``generate.py``) walks a prompt inside a task and so needs the model there.  Here all open prompts take one step
together: their last tokens are joined with a stored table of successors, by the longest context that the model knows, a token is drawn and
appended.  The model is only ever the other side of a join; it reaches neither the driver nor a task as a whole, and the contexts may be of any number.

Every pass is one job whose result is written under the shared folder and read again, so no plan grows with the number of steps
and a lost executor repeats one pass at most.  Prompts that are full leave the loop.

The successors of a context are its ``k`` most frequent next tokens (ties by smaller id).  Draws are those of ``generate``:
``md5(seed|run|item|length)`` as a 32-bit number against cumulative counts, in exact integers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import GENERATION_SEED, TOP_K
from ..session import stage_table
from .ngram import context_columns


def successors(counts: DataFrame, order: int, k: int = TOP_K) -> DataFrame:
    """``(n, context, bs, cs)`` from target counts ``(a*, b, c)`` of ``order``: the k most frequent tokens after every context of
    ``order`` - 1 to no tokens (``n`` of them, as text), with their counts.

    ``row_number() <= k`` plans a partial group limit before the shuffle; the empty context's rows meet after a partial count of theirs."""
    found = []
    for size in range(order - 1, -1, -1):
        columns = context_columns(size + 1)
        rows = counts.where(F.col(columns[0]).isNotNull()) if columns else counts
        rows = rows.groupBy(*columns, "b").agg(F.sum("c").cast("long").alias("c"))
        name = F.array_join(F.array(*[F.col(c).cast("string") for c in columns]), " ") if columns else F.lit("")
        rows = rows.select(F.lit(size).alias("n"), name.alias("context"), "b", "c")
        place = F.row_number().over(Window.partitionBy("n", "context").orderBy(F.desc("c"), F.asc("b")))
        rows = rows.withColumn("place", place).where(F.col("place") <= k)
        listed = F.array_sort(F.collect_list(F.struct("place", "b", "c")))
        found.append(rows.groupBy("n", "context").agg(listed.alias("l")).select("n", "context", F.col("l.b").alias("bs"), F.col("l.c").alias("cs")))
    return reduce(DataFrame.unionByName, found)


def draw(seed: int) -> Column:
    """The 32-bit draw of a row's next token, as a decimal."""
    message = F.concat_ws("|", F.lit(str(seed)), "run", F.col("item_id").cast("string"), F.size("tokens").cast("string"))
    return F.conv(F.substring(F.md5(message), 1, 8), 16, 10).cast("decimal(20,0)")


def picked(u: Column, bs: Column, cs: Column) -> Column:
    """The first candidate whose cumulative count exceeds ``u / 2**32`` of the total."""
    wide = lambda c: c.cast("decimal(20,0)")
    total = F.aggregate(cs, F.lit(0).cast("long"), lambda a, c: a + c)
    upto = lambda i: F.aggregate(F.slice(cs, 1, i + 1), F.lit(0).cast("long"), lambda a, c: a + c)
    places = F.sequence(F.lit(0), F.size(cs) - 1)
    first = F.filter(places, lambda i: u * wide(total) < wide(upto(i)) * F.lit(1 << 32).cast("decimal(20,0)"))
    return F.get(bs, F.coalesce(F.get(first, F.lit(0)), F.size(cs) - 1))


def _step(open_prompts: DataFrame, model: DataFrame, order: int, seed: int) -> DataFrame:
    """One more token for each open prompt: its contexts, longest first, meet the model, and the longest known one is kept."""
    rows = open_prompts
    for size in range(order - 1, -1, -1):
        known = model.where(F.col("n") == size).select(F.col("context").alias(f"_x{size}"), F.col("bs").alias(f"_b{size}"), F.col("cs").alias(f"_c{size}"))
        context = F.array_join(F.slice("tokens", F.greatest(F.size("tokens") - F.lit(size - 1), F.lit(1)), size), " ") if size else F.lit("")
        context = F.when(F.size("tokens") >= size, context).alias(f"_x{size}")
        # what is asked for meets the model first: an outer join would shuffle and sort the whole model in every pass
        asked = open_prompts.select(context).where(F.col(f"_x{size}").isNotNull()).distinct()
        rows = rows.withColumn(f"_x{size}", context).join(known.join(asked, f"_x{size}"), f"_x{size}", "left")
    sizes = range(order - 1, -1, -1)
    rows = rows.withColumns({"_bs": F.coalesce(*[F.col(f"_b{s}") for s in sizes]), "_cs": F.coalesce(*[F.col(f"_c{s}") for s in sizes])})
    token = picked(draw(seed), F.col("_bs"), F.col("_cs")).cast("int")
    return rows.select("run", "item_id", F.concat("tokens", F.array(token)).alias("tokens"))


def generate_by_joins(prompts: DataFrame, model: DataFrame, order: int, max_length: int, seed: int = GENERATION_SEED) -> DataFrame:
    """``prompts(run, item_id, tokens)`` -> ``(run, item_id, tokens)`` grown to ``max_length`` from ``successors``; a prompt that is
    not shorter is only cut (G4)."""
    limit = int(max_length)
    rows = stage_table(prompts.select("run", F.col("item_id").cast("long"), F.col("tokens").cast("array<int>")), "prompts")
    if model.where("n = 0").limit(1).count() == 0:
        raise ValueError("the model knows no token")
    done = rows.where(F.size("tokens") >= limit).select("run", "item_id", F.slice("tokens", 1, limit).alias("tokens"))
    finished, rows = [done], rows.where(F.size("tokens") < limit)
    # as many passes as the shortest prompt needs; each closes those that are full
    shortest = rows.agg(F.min(F.size("tokens"))).first()[0]
    for _ in range(limit - shortest if shortest is not None else 0):
        stepped = stage_table(_step(rows, model, order, seed), "generated")
        finished.append(stepped.where(F.size("tokens") >= limit))
        rows = stepped.where(F.size("tokens") < limit)
    return reduce(DataFrame.unionByName, finished)
