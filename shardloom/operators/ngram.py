"""D9 + D10 with longer contexts: an interpolated backoff model over contexts of up to ``order - 1`` tokens, as joins.

The reference's network reads 256 tokens of context; the pair counts read one.  Here a target's probability mixes what followed its
whole context with what followed ever shorter ones (interpolated Kneser-Ney with one discount ``D``):

    p_k(b | ctx) = max(n_k(ctx, b) - D, 0) / n_k(ctx) + D * types_k(ctx) / n_k(ctx) * p_(k-1)(b | shorter ctx)

``n_k`` is a count at the highest order, and below it the continuation count: how many different tokens stand before ``(ctx, b)``.
Order 0 is uniform over the vocabulary, and a context never seen leaves all to the shorter one.

Every order is a table keyed by its context and token, made from the order above by one aggregate; a target reaches an order by an
equi-join on the suffix of its context.  Nothing is broadcast by this module and nothing reaches the driver: the tables may be of any
size.  Targets are counted before they are joined, so a frequent one is one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a count that is left to shorter contexts.
DISCOUNT = 0.75


def context_columns(order: int) -> list[str]:
    """``a{order-1} .. a1``: the context's tokens, the one next to the target last."""
    return [f"a{k}" for k in range(order - 1, 0, -1)]


def ngrams(seqs: DataFrame, order: int, keep: tuple = ()) -> DataFrame:
    """One row per target of the sequences ``(x, y)``: its context of ``order - 1`` tokens ``a*`` (nulls before a sequence's start) and ``b``."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    place = F.explode(F.sequence(F.lit(0), F.size("y") - 1))
    rows = seqs.where(F.size("y") > 0).select(*keep, "x", "y", place.alias("_j"))
    context = [F.when(F.col("_j") >= k - 1, F.get("x", F.col("_j") - (k - 1))).alias(f"a{k}") for k in range(order - 1, 0, -1)]
    return rows.select(*keep, *context, F.get("y", F.col("_j")).alias("b"))


def target_counts(seqs: DataFrame, order: int, keep: tuple = ()) -> DataFrame:
    """``(keep..., a*, b, c)``: how often each context and target occurs; contexts at a sequence's start have nulls."""
    return ngrams(seqs, order, keep).groupBy(*keep, *context_columns(order), "b").agg(F.count(F.lit(1)).alias("c"))


def order_tables(counts: DataFrame, order: int) -> dict[int, DataFrame]:
    """``{k: (a*, b, n)}`` for k = order .. 1 from target counts: counts at the highest order, continuation counts below.

    Shorter contexts at the start of a sequence have a left neighbour only where one is there; a null neighbour counts as one more."""
    whole = counts.where(F.col(f"a{order - 1}").isNotNull()) if order > 1 else counts
    tables = {order: whole.select(*context_columns(order), "b", F.col("c").cast("long").alias("n"))}
    # contexts cut by a sequence's start are evidence of the orders that they reach
    for k in range(order - 1, 0, -1):
        columns = [*context_columns(k), "b"]
        reach = counts.where(F.col(f"a{k - 1}").isNotNull()) if k > 1 else counts
        tables[k] = reach.select(*columns, f"a{k}").distinct().groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return tables


def ngram_counts(counts: DataFrame, order: int) -> DataFrame:
    """All orders in one table: ``(k, context, b, n)``, the context as text."""
    tables = order_tables(counts, order)
    shown = lambda k: F.array_join(F.array(*[F.col(c).cast("string") for c in context_columns(k)]), " ") if k > 1 else F.lit("")
    parts = [t.select(F.lit(k).alias("k"), shown(k).alias("context"), "b", "n") for k, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def _joined(targets: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """Targets with ``n_k`` (null: not seen), ``of_k`` and ``types_k`` of their context (null: never seen)."""
    columns = context_columns(k)
    seen = table.withColumnRenamed("n", f"n_{k}")
    totals = table.groupBy(*columns) if columns else table.groupBy()
    totals = totals.agg(F.sum("n").alias(f"of_{k}"), F.count(F.lit(1)).alias(f"types_{k}"))
    out = targets.join(seen, [*columns, "b"], "left")
    if columns:
        return out.join(totals, columns, "left")
    one = totals.first()  # the two numbers of the empty context
    return out.withColumns({f"of_{k}": F.lit(one[f"of_{k}"] or 0), f"types_{k}": F.lit(one[f"types_{k}"])})


def with_probability(targets: DataFrame, tables: dict[int, DataFrame], vocab_size: int, discount: float = DISCOUNT) -> DataFrame:
    """``targets (a*, b, ...)`` with ``p``; of contexts with nulls only the tokens that are there count."""
    if not 0 < discount <= 1 or vocab_size <= 0:
        raise ValueError("discount must be in (0, 1] and the vocabulary not empty")
    p: Column = F.lit(1.0 / vocab_size)
    rows = targets
    for k in sorted(tables):
        rows = _joined(rows, tables[k], k)
        n, of, types = F.coalesce(f"n_{k}", F.lit(0)), F.col(f"of_{k}"), F.col(f"types_{k}")
        mixed = F.greatest(n - F.lit(discount), F.lit(0.0)) / of + F.lit(discount) * types / of * p
        p = F.when(F.coalesce(of, F.lit(0)) > 0, mixed).otherwise(p)
        rows = rows.withColumn(f"p_{k}", p)
        p = F.col(f"p_{k}")
    used = [f"{c}_{k}" for k in tables for c in ("n", "of", "types", "p")]
    return rows.withColumn("p", p).drop(*used)


def cross_entropy(test_counts: DataFrame, train_counts: DataFrame, order: int, vocab_size: int, discount: float = DISCOUNT) -> DataFrame:
    """Mean ``-ln p`` over the test targets ``(a*, b, c)``: one row ``(n_targets, cross_entropy)``."""
    scored = with_probability(test_counts, order_tables(train_counts, order), vocab_size, discount)
    return scored.agg(F.sum("c").cast("long").alias("n_targets"), (F.sum(-F.log("p") * F.col("c")) / F.sum("c")).alias("cross_entropy"))
