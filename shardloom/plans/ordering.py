"""Order-as-meaning helpers: exact prefix sums and row numbers without a
single-task window over row-level data.

``with_offsets`` (E1): one aggregate over the key column gives each group's
quantiles, which cut it into ranges of like size however its keys are spread.
Range totals (one row per group and range, a number set by the configuration
and not by the data) get the only un-partitioned window; every other window is
partitioned by range.  The quantiles and the totals are written once.  One plan
at every size.

``row_index`` numbers rows of each group in a total order.  A range
repartition on (group, order) splits even a group holding a third of all rows
over many tasks; the partition id and in-partition position are frozen by a
staged write, then per-partition counts are summed over a small table.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table

#: Ranges per shuffle partition when a caller names no number.
RANGES_PER_PARTITION = 4


def _bounds_at_or_below(bounds: str, key: Column) -> Column:
    """How many of the sorted ``bounds`` are <= ``key``: binary search over the array."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(20))])
    fits = lambda at, step: (at + step <= F.size(bounds)) & (F.get(bounds, at + step - 1) <= key)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at, step), at + step).otherwise(at))


def with_ranges(df: DataFrame, group_cols: Sequence[str], ord_col: str, ranges: int) -> DataFrame:
    """Add ``_range``: which of about ``ranges`` quantile ranges of its group a
    key lies in.  A null key fails the job.  The bounds table has one row per
    group (a dataset), so it is small enough to ship to every task."""
    if not 0 < ranges < 1 << 20:
        raise ValueError("ranges must be in 1 .. 2**20 - 1")
    share = ", ".join(str(k / ranges) for k in range(1, ranges)) or "0.5"
    cut = f"percentile_approx(cast(`{ord_col}` as bigint), array({share}), {max(10_000, 10 * ranges)})"
    # the quantiles are approximate and depend on the order in which parts of them meet: written once, so that every reader of
    # the ranges has the same ones
    bounds = stage_table(df.groupBy(*group_cols).agg(F.array_distinct(F.expr(cut)).alias("_bounds")), "range-bounds")
    at = _bounds_at_or_below("_bounds", F.col(ord_col).cast("long"))
    at = F.when(F.col(ord_col).isNull(), F.raise_error(F.lit(f"null order key in {ord_col}"))).otherwise(at)
    return df.join(F.broadcast(bounds), list(group_cols)).withColumn("_range", at).drop("_bounds")


def with_offsets(df: DataFrame, n_col: str = "n", ranges: int = 0,
                 group_cols: Sequence[str] = ("source_ord",), ord_col: str = "doc_ord",
                 out_col: str = "g") -> DataFrame:
    """Add ``g`` = exclusive running sum of ``n`` in (group_cols, ord_col)
    order over the whole table.  Null and repeated order keys fail the job: a
    position in the stream would not be defined."""
    group_cols = list(group_cols)
    ranges = ranges or RANGES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = with_ranges(df, group_cols, ord_col, ranges)
    totals = stage_table(keyed.groupBy(*group_cols, "_range").agg(F.sum(n_col).cast("long").alias("_rn")), "range-totals")
    before = Window.orderBy(*group_cols, "_range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*group_cols, "_range", F.coalesce(F.sum("_rn").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group_cols, "_range").orderBy(ord_col)
    local = F.coalesce(F.sum(n_col).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    again = F.lag(ord_col).over(inside) == F.col(ord_col)
    local = F.when(again, F.raise_error(F.concat(F.lit(f"repeated order key in {ord_col}: "), F.col(ord_col).cast("string")))).otherwise(local)
    out = keyed.withColumn("_local", local).join(base, [*group_cols, "_range"])
    return (out.withColumn(out_col, (F.col("_base") + F.col("_local")).cast("long"))
            .drop("_range", "_local", "_base"))


def row_index(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
              out_col: str = "i", partitions: int | None = None,
              count_col: str | None = None) -> DataFrame:
    """0-based position of each row inside its group, ordered by ``order_cols``
    (which must make the order total), and the group's number of rows if
    ``count_col`` names a column for it.  Skew-safe; see module doc."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group_cols, *order_cols]
    ranged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    frozen = stage_table(ranged, "row-index")
    starts = frozen.groupBy("_pid", *group_cols).agg(
        F.min("_mid").alias("_m0"), F.count(F.lit(1)).alias("_cnt"))
    w = (Window.partitionBy(*group_cols).orderBy("_pid")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = starts.withColumn("_base", F.sum("_cnt").over(w) - F.col("_cnt"))
    sizes = []
    if count_col:
        sizes = [F.sum("_cnt").over(Window.partitionBy(*group_cols)).alias(count_col)]
    out = frozen.join(starts.select("_pid", *group_cols, "_m0", "_base", *sizes), ["_pid", *group_cols])
    return (out.withColumn(out_col, (F.col("_base") + F.col("_mid") - F.col("_m0")).cast("long"))
            .drop("_pid", "_mid", "_m0", "_base"))
