"""Skew-safe ranking primitives.

``Window.partitionBy(g).orderBy(v)`` sends each group to one task, so a group
holding a third of all rows becomes one straggler task (AQE splits skewed
joins, not windows).  The helpers here compute the same exact ranks with
bounded groups:

1. ordered value buckets from one global quantile sketch (bucket count
   scales with the row count, boundaries assigned by binary search);
2. every value in an earlier bucket is strictly smaller, every value in a
   later bucket strictly larger, so ties never straddle buckets and the
   split is exact;
3. rank inside (group, bucket) with a window whose partitions are ~1/B of the
   group, plus the row count of earlier buckets (a window over the tiny
   (group, bucket) count table).

Without a partition column the same trick gives a global ``row_number``
(id renumbering) without a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1_000_000
MIN_BUCKETS = 32
MAX_BUCKETS = 65_536


def _bucketed(df: DataFrame, value: str, buckets: int | None = None) -> DataFrame:
    """Tag rows with an ordered bucket of ``value`` (ties share a bucket).

    The bucket count follows the data size (about ``ROWS_PER_BUCKET`` rows per
    bucket), the boundaries come from one global quantile sketch (a 1-row
    aggregate; <= MAX_BUCKETS doubles reach the driver), and MLlib's
    ``Bucketizer`` assigns buckets JVM-side by binary search.  Any monotone
    bucketing keeps the ranks exact; the sketch only balances the buckets, so
    a group holding a third of all rows is spread over about a third of them.
    NULL values go to a bucket after all others.
    """
    import math

    from pyspark.ml.feature import Bucketizer
    if buckets is None:
        n = df.count()
        buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, math.ceil(n / ROWS_PER_BUCKET)))
    probs = [i / buckets for i in range(1, buckets)]
    v = F.col(value).cast("double")
    row = df.agg(F.percentile_approx(v, probs, max(10_000, 10 * buckets)).alias("b")).first()
    bounds = sorted({float(x) for x in (row["b"] or []) if x is not None})
    splits = [float("-inf")] + bounds + [float("inf")]
    if len(splits) < 3:
        splits = [float("-inf"), 0.0, float("inf")]
    tagged = df.withColumn("_bv", F.coalesce(v, F.lit(0.0)))
    tagged = Bucketizer(splits=splits, inputCol="_bv", outputCol="_bd").transform(tagged)
    return (tagged.withColumn("_bkt", F.when(F.col(value).isNull(), F.lit(len(splits)))
                              .otherwise(F.col("_bd")).cast("int"))
            .drop("_bv", "_bd"))


def _offsets(tagged: DataFrame, group: list[str], rows=None) -> DataFrame:
    counts = tagged.groupBy(*group, "_bkt").agg((rows if rows is not None else F.count(F.lit(1))).alias("_cnt"))
    w = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy("_bkt")
    return (counts
            .withColumn("_before", F.coalesce(
                F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("_group_n", F.sum("_cnt").over(
                w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            .drop("_cnt"))


def count_lower_in_group(df: DataFrame, group: list[str], value: str,
                         lower_col: str = "n_lower", size_col: str = "group_n",
                         buckets: int | None = None, staged: bool = False) -> DataFrame:
    """Add ``#rows in the same group with a strictly lower non-null value``
    (NULL values count as never lower) and the group's total row count.

    The input is written once and read back by all consumers (``staged``: it is
    written already).  Ranks are
    taken over (group, value) counts, so a value that many rows share is one
    row in the window; they come back to the rows by a join on the value."""
    from valora.functions.stats import join_by
    from valora.session import stage
    if not staged:
        df = stage(df, "rank_rows")
    counts = _bucketed(stage(df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c")), "rank_values"), value, buckets)
    offs = _offsets(counts, group, F.sum("_c"))
    earlier = Window.partitionBy(*group, "_bkt").orderBy(F.col(value).asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    ranks = join_by(counts.withColumn("_local", F.coalesce(F.sum("_c").over(earlier), F.lit(0))), offs, [*group, "_bkt"])
    ranks = ranks.select(*group, value, (F.col("_before") + F.col("_local")).cast("bigint").alias(lower_col),
                         F.col("_group_n").cast("bigint").alias(size_col))
    return join_by(df, ranks, [*group, value])


def global_row_number(df: DataFrame, order_col: str, out_col: str = "row_id",
                      buckets: int | None = None) -> DataFrame:
    """1..n in ``order_col`` order (unique key expected) without moving all
    rows through one task.  The only single-partition step sorts the bucket
    count table (<= MAX_BUCKETS rows)."""
    from valora.session import stage
    tagged = _bucketed(stage(df, "rownum_rows"), order_col, buckets)  # several consumers
    offs = _offsets(tagged, [])
    w = Window.partitionBy("_bkt").orderBy(F.col(order_col).asc_nulls_last())
    return (tagged.withColumn("_local", F.row_number().over(w))
            .join(F.broadcast(offs), ["_bkt"], "left")  # <= MAX_BUCKETS + 2 rows
            .withColumn(out_col, (F.col("_before") + F.col("_local")).cast("bigint"))
            .drop("_bkt", "_local", "_before", "_group_n"))
