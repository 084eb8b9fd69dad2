"""AI usage audit log: append, daily cost, usage statistics (batch)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AUDIT_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("property_id", T.LongType()), T.StructField("prompt_hash", T.StringType()),
    T.StructField("model", T.StringType()), T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()), T.StructField("cost_estimate", T.DoubleType()),
    T.StructField("success", T.BooleanType()), T.StructField("error_message", T.StringType()),
    T.StructField("latency_ms", T.LongType()),
])


def conform(df: DataFrame) -> DataFrame:
    """Cast/complete a frame to the 11-column audit schema."""
    cols = []
    for f in AUDIT_SCHEMA.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def append(records: DataFrame, path: str) -> None:
    """Append audit records to the audit table (Parquet, append-only)."""
    conform(records).write.mode("append").parquet(path)


def daily_cost(log: DataFrame, day: dt.date | None = None) -> DataFrame:
    """Total cost per UTC day (one day when ``day`` is given; NULL -> 0)."""
    by_day = log.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.coalesce(F.sum("cost_estimate"), F.lit(0.0)).alias("total_cost"))
    if day is None:
        return by_day
    one = log.where(F.to_date("timestamp") == F.lit(day)).agg(
        F.coalesce(F.sum("cost_estimate"), F.lit(0.0)).alias("total_cost"))
    return one.select(F.lit(day).alias("day"), "total_cost")


def usage_stats(log: DataFrame, days: int = 7, now: dt.datetime | None = None) -> DataFrame:
    """Calls, success %, cost, avg latency, token sums over the last ``days``
    (true timestamp comparison); all-zero row when nothing matches."""
    cond = F.lit(True)
    if now is not None:
        cond = F.col("timestamp") >= F.lit(now - dt.timedelta(days=days))
    d = log.where(cond)
    n = F.count(F.lit(1))
    ok = F.sum(F.when(F.col("success"), 1).otherwise(0))
    return d.agg(
        n.alias("total_calls"),
        F.coalesce(F.when(n > 0, ok * 100.0 / n), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.sum("cost_estimate"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("total_output_tokens"))


def with_cost(log: DataFrame, spark: SparkSession) -> DataFrame:
    from valora.operators.memo import estimate_cost
    return estimate_cost(log, spark)
