"""Exact quantiles without a map of all values in one task.

``F.median`` / ``F.percentile`` merge a value -> count map for each group in
one task, as large as the group.  ``quantiles`` finds the same numbers from
ranks instead:

1. rows become (group, metric, value) counts, partially aggregated, written
   once and read back; copies of a value are one row;
2. ordered value buckets (borders from a sketch per metric; they only balance)
   are counted per group, and running totals name the bucket of each rank;
3. only the rows of those buckets are ranked, each bucket for itself.

The number of buckets follows the rows (about ``BUCKET_ROWS`` each), so no
task ranks more than a bucket's distinct values; below that size there is one
bucket and step 2 falls away.

Steps 1 to 3 are for tables in which a group may be large.  Where Spark's own
estimate of the whole input is at most ``SMALL_BYTES``, no group can be larger
than that: then ``percentile`` does it in one job, without a staged table.  The
result is the linear interpolation at rank p * (n - 1) of the non-NULL values,
by the same formula on either way and for any number of buckets.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valora.session import stage

BUCKET_ROWS = 1_000_000
SMALL_BYTES = 64 << 20
MAX_BUCKETS = 4096


def _buckets(values: DataFrame, metrics: int, buckets: int) -> DataFrame:
    """``b``: ordered bucket of the value within its metric."""
    from pyspark.ml.feature import Bucketizer
    probs = [i / buckets for i in range(1, buckets)]
    borders = {r["m"]: r["q"] for r in values.groupBy("m").agg(
        F.percentile_approx("v", probs, max(10_000, 10 * buckets)).alias("q")).collect()}
    split = [[-math.inf, *(sorted({float(x) for x in borders.get(i) or [] if math.isfinite(x)}) or [0.0]), math.inf]
             for i in range(metrics)]
    cols = [f"v{i}" for i in range(metrics)]
    wide = values.withColumns({c: F.when(F.col("m") == i, F.col("v")).otherwise(F.lit(float("nan"))) for i, c in enumerate(cols)})
    tagged = Bucketizer(splitsArray=split, inputCols=cols, outputCols=[f"b{i}" for i in range(metrics)],
                        handleInvalid="keep").transform(wide)
    pick = reduce(lambda e, i: F.when(F.col("m") == i, F.col(f"b{i}")).otherwise(e), range(metrics), F.lit(0.0))
    return tagged.withColumn("b", pick.cast("int")).drop(*cols, *[f"b{i}" for i in range(metrics)])


def small(df: DataFrame) -> bool:
    """Whether Spark estimates the whole of ``df`` at SMALL_BYTES or less."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= SMALL_BYTES


def _in_one_job(df: DataFrame, by: list[str], wanted: dict[str, tuple[Column | str, float]]) -> DataFrame:
    col = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    keys = [f"k{i}" for i in range(len(by))]
    done = (df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], *[col(c).alias(f"x_{n}") for n, (c, _) in wanted.items()])
            .groupBy(*keys).agg(*[F.percentile(f"x_{n}", F.lit(p)).alias(n) for n, (_, p) in wanted.items()]))
    if by:
        done = done.where(reduce(lambda x, y: x | y, [F.col(n).isNotNull() for n in wanted]))
    return done.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *wanted)


def quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[Column | str, float]]) -> DataFrame:
    """``by`` + one column for each name in ``wanted``: name -> (column, p).

    Groups (NULL keys included) without any value have no row; without ``by``
    there is always one row.
    """
    if small(df):
        return _in_one_job(df, by, wanted)
    exprs: dict[str, int] = {}
    cols: list[Column] = []
    metric = {}
    for name, (c, _) in wanted.items():
        text = c if isinstance(c, str) else str(c)
        if text not in exprs:
            exprs[text] = len(cols)
            cols.append((F.col(c) if isinstance(c, str) else c).cast("double"))
        metric[name] = exprs[text]
    keys = [f"k{i}" for i in range(len(by))]
    pairs = F.array(*[F.struct(F.lit(i).alias("m"), c.alias("v")) for i, c in enumerate(cols)])
    long = (df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.explode(pairs).alias("p"))
            .select(*keys, "p.m", "p.v").where("v is not null"))
    values = stage(long.groupBy(*keys, "m", "v").agg(F.count(F.lit(1)).alias("c")), "quantile_values")
    done = _from_counts(values, keys, len(cols), {n: (metric[n], p) for n, (_, p) in wanted.items()})
    return done.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *wanted)


def quantiles_of_counts(values: DataFrame, by: list[str], wanted: dict[str, tuple[int, float]]) -> DataFrame:
    """The same from value counts: staged rows (by..., m, v, c), where metric m
    has the value v c times in the group; ``wanted``: name -> (m, p)."""
    return _from_counts(values, by, 1 + max(m for m, _ in wanted.values()), wanted).select(*by, *wanted)


def _from_counts(values: DataFrame, keys: list[str], metrics: int, wanted: dict[str, tuple[int, float]]) -> DataFrame:
    buckets = min(MAX_BUCKETS, max(1, math.ceil(values.count() / BUCKET_ROWS)))
    group = [*keys, "m"]
    whole = Window.partitionBy(*group)
    if buckets > 1:
        values = stage(_buckets(values, metrics, buckets), "quantile_buckets")
        up_to = whole.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        sums = (values.groupBy(*group, "b").agg(F.sum("c").alias("bc"))
                .withColumn("before", F.coalesce(F.sum("bc").over(up_to), F.lit(0)))
                .withColumn("n", F.sum("bc").over(whole)))
        holds = reduce(lambda x, y: x | y, [
            (F.col("m") == m) & (F.col("before") <= r) & (r < F.col("before") + F.col("bc"))
            for m, p in wanted.values() for r in _ranks(F.col("n"), p)])
        right = sums.where(holds).select(*[F.col(x).alias(f"r_{x}") for x in [*group, "b"]], "before", "n")
        same = reduce(lambda x, y: x & y, [F.col(x).eqNullSafe(F.col(f"r_{x}")) for x in [*group, "b"]])
        values = values.join(right, same)
        inner = Window.partitionBy(*group, "b")
        start = F.col("before")
    else:
        inner, start = whole, F.lit(0)
        values = values.withColumn("n", F.sum("c").over(whole))
    ranked = values.withColumn("to", start + F.sum("c").over(
        inner.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    out = []
    for name, (m, p) in wanted.items():
        lo, hi = _ranks(F.col("n"), p)
        at = lambda r, i=m: F.max(F.when(
            (F.col("m") == i) & (F.col("to") - F.col("c") <= r) & (r < F.col("to")), F.col("v")))
        rank = F.lit(p) * (F.col("n") - 1)
        up, down = (F.max(F.when(F.col("m") == m, x)) for x in (hi - rank, rank - lo))
        out.append(F.when((up == 0) & (down == 0), at(lo)).otherwise(up * at(lo) + down * at(hi)).alias(name))
    return ranked.groupBy(*keys).agg(*out)


def _ranks(n: Column, p: float) -> tuple[Column, Column]:
    """The two ranks (from 0) that the quantile lies between."""
    return F.floor(F.lit(p) * (n - 1)), F.ceil(F.lit(p) * (n - 1))


def join_by(df: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """Left join on keys that may be NULL."""
    right = other.select(*[F.col(c).alias(f"_j_{c}") for c in by], *[c for c in other.columns if c not in by])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in by])
    return df.join(right, same, "left").drop(*[f"_j_{c}" for c in by])


def ranked_values(df: DataFrame, by: str, column: str, ranks) -> DataFrame:
    """(by, n, r0, r1, ...): per group the number of values and those at the
    ranks (from 0) that ``ranks(n)`` names; NULL beyond the ends.  Ranks run
    over value counts, one row for each different value of a group."""
    counts = (df.where(F.col(column).isNotNull()).groupBy(by, F.col(column).alias("v"))
              .agg(F.count(F.lit(1)).alias("c")))
    whole = Window.partitionBy(by)
    to = F.sum("c").over(whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"n": F.sum("c").over(whole), "to": to})
    wanted = ranks(F.col("n"))
    return ranked.groupBy(by, "n").agg(*[
        F.max(F.when((F.col("to") - F.col("c") <= r) & (r < F.col("to")), F.col("v"))).alias(f"r{i}")
        for i, r in enumerate(wanted)])
