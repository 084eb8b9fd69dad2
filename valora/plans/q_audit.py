"""Audit roll-ups (A17, A18, S14) and streaming jobs (ST1-ST3)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from valora.operators import audit as AU
from valora.operators import memo as ME
from valora.plans.catalog import register, with_views
from valora.plans.q_spatial import LC, LCP, _lv
from valora.plans.q_text import _dim_sql
from valora.session import ensure_checkpoint_dir
from valora.sources.tables import ai_audit_log, demand_feed, listings
from valora.streaming import jobs as ST

COSTED = with_views("ai_audit_log").rstrip("\n") + f"""
, costed AS (SELECT a.*, a.input_tokens / 1000 * coalesce(md.input_cost_1k, CAST(0.001 AS DOUBLE))
    + a.output_tokens / 1000 * coalesce(md.output_cost_1k, CAST(0.002 AS DOUBLE)) AS cost_estimate
  FROM ai_audit_log a LEFT JOIN {_dim_sql()} ON a.model = md.model)
""".replace("\n, costed AS", ", costed AS", 1)


def _costed(spark, sf):
    return ME.estimate_cost(ai_audit_log(spark, sf), spark)


@register("daily_ai_cost", COSTED + """
SELECT strftime(CAST(timestamp AS DATE), '%Y-%m-%d') AS day, ROUND(coalesce(SUM(cost_estimate), 0), 8) AS total_cost
FROM costed GROUP BY CAST(timestamp AS DATE)""")
def q_daily_cost(spark, sf):
    out = AU.daily_cost(_costed(spark, sf))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"),
                      F.round("total_cost", 8).alias("total_cost"))


@register("ai_usage_stats", COSTED + """
SELECT COUNT(*) AS total_calls,
  coalesce(CASE WHEN COUNT(*) > 0 THEN SUM(CASE WHEN success THEN 1 ELSE 0 END) * CAST(100 AS DOUBLE) / COUNT(*) END, 0) AS success_rate,
  ROUND(coalesce(SUM(cost_estimate), 0), 8) AS total_cost, ROUND(coalesce(AVG(latency_ms), 0), 6) AS avg_latency_ms,
  CAST(coalesce(SUM(input_tokens), 0) AS BIGINT) AS total_input_tokens,
  CAST(coalesce(SUM(output_tokens), 0) AS BIGINT) AS total_output_tokens
FROM costed WHERE timestamp >= (SELECT MAX(timestamp) FROM costed) - INTERVAL 7 DAY""")
def q_usage_stats(spark, sf):
    log = _costed(spark, sf)
    now = log.agg(F.max("timestamp").alias("_now"))  # one row
    recent = (log.crossJoin(F.broadcast(now))
              .where(F.col("timestamp") >= F.col("_now") - F.expr("INTERVAL 7 DAYS")).drop("_now"))
    out = AU.usage_stats(recent)
    return out.select("total_calls", "success_rate", F.round("total_cost", 8).alias("total_cost"),
                      F.round("avg_latency_ms", 6).alias("avg_latency_ms"),
                      F.col("total_input_tokens").cast("bigint").alias("total_input_tokens"),
                      F.col("total_output_tokens").cast("bigint").alias("total_output_tokens"))


def _scratch(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:8]}")


@register("audit_append", COSTED + """
SELECT id, timestamp, property_id, prompt_hash, model, input_tokens, output_tokens, cost_estimate,
  success, CAST(NULL AS VARCHAR) AS error_message, latency_ms FROM costed""")
def q_audit_append(spark, sf):
    """Append the costed log in two batches to an audit table; read it back."""
    path = _scratch(spark, "audit_table")
    log = _costed(spark, sf)
    AU.append(log.where(F.col("id") % 2 == 0), path)
    AU.append(log.where(F.col("id") % 2 == 1), path)
    return spark.read.parquet(path)


@register("audit_rollup_stream", COSTED + """
SELECT strftime(CAST(timestamp AS DATE), '%Y-%m-%d') AS day, COUNT(*) AS calls,
  CAST(SUM(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS successful_calls, ROUND(SUM(cost_estimate), 8) AS total_cost,
  ROUND(AVG(latency_ms), 6) AS avg_latency_ms, CAST(SUM(input_tokens) AS BIGINT) AS input_tokens,
  CAST(SUM(output_tokens) AS BIGINT) AS output_tokens
FROM costed GROUP BY CAST(timestamp AS DATE)""")
def q_audit_stream(spark, sf):
    """The log lands and is rolled up; then a closing mark two days after its
    last row lands, and the stream goes on from its checkpoint: the watermark
    passes every day of the log, so the last one is emitted too.  The mark's
    own day stays open and never reaches the sink."""
    base = _scratch(spark, "audit")
    src = f"{base}/source"
    log = AU.conform(_costed(spark, sf))
    mark = log.agg((F.max("timestamp") + F.expr("INTERVAL 2 DAYS")).alias("timestamp"))
    for landing in (log, AU.conform(mark)):
        landing.write.mode("append").parquet(src)
        stream = ST.read_stream(spark, src, AU.AUDIT_SCHEMA, max_files=1_000_000)
        ST.run_available_now(ST.audit_rollup(stream), f"{base}/sink", f"{base}/ckpt")
    out = spark.read.parquet(f"{base}/sink")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "calls", "successful_calls",
                      F.round("total_cost", 8).alias("total_cost"),
                      F.round("avg_latency_ms", 6).alias("avg_latency_ms"), "input_tokens", "output_tokens")


@register("audit_rollup_late", COSTED.rstrip() + """
, first_landing AS (SELECT max(timestamp) - INTERVAL 1 HOUR AS closed FROM costed WHERE id % 50 <> 0)
SELECT strftime(CAST(timestamp AS DATE), '%Y-%m-%d') AS day, COUNT(*) AS calls,
  COUNT(*) FILTER (id % 50 = 0 AND CAST(timestamp AS DATE) + INTERVAL 1 DAY <= closed) AS late_calls,
  CAST(SUM(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS successful_calls, ROUND(SUM(cost_estimate), 8) AS total_cost,
  ROUND(AVG(latency_ms), 6) AS avg_latency_ms, CAST(SUM(input_tokens) AS BIGINT) AS input_tokens,
  CAST(SUM(output_tokens) AS BIGINT) AS output_tokens
FROM costed, first_landing GROUP BY CAST(timestamp AS DATE)""")
def q_audit_late(spark, sf):
    """Every fiftieth call lands after all others, most of them for days that
    are closed by then: they are counted as late, and no call is lost."""
    base = _scratch(spark, "audit")
    src = f"{base}/source"
    log = AU.conform(_costed(spark, sf))
    for landing in (log.where("id % 50 <> 0"), log.where("id % 50 = 0")):
        landing.write.mode("append").parquet(src)
        stream = ST.read_stream(spark, src, AU.AUDIT_SCHEMA, max_files=1_000_000)
        ST.run_available_now(stream, None, f"{base}/ckpt", mode="update", each=ST.rollup_merge(base))
    out = ST.rollup_table(spark, base)
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "calls", "late_calls", "successful_calls",
                      F.round("total_cost", 8).alias("total_cost"), F.round("avg_latency_ms", 6).alias("avg_latency_ms"),
                      "input_tokens", "output_tokens")


DEDUPED_SQL = with_views("demand_feed") + """
SELECT id, address, source, price FROM (
  SELECT *, row_number() OVER (PARTITION BY coalesce(address, 'id:' || CAST(id AS VARCHAR))
                               ORDER BY source, id) AS rn FROM demand_feed) x WHERE rn = 1"""


@register("listing_feed_dedupe_forever", DEDUPED_SQL)
def q_feed_forever(spark, sf):
    """The feeds land a week apart and then the first one once more; keys are
    remembered for ever, and the stream starts anew from its checkpoint at
    each landing."""
    base = _scratch(spark, "feed")
    src = f"{base}/source"
    key = F.coalesce(F.col("address"), F.concat(F.lit("id:"), F.col("id").cast("string")))
    for week, name in enumerate(("feed_a", "feed_b", "feed_a")):
        feed = demand_feed(spark, sf).where(F.col("source") == name).withColumn(
            "ingested_at", F.timestamp_seconds(F.lit(1_735_689_600 + 604_800 * week)))
        feed.repartition(4, key).sortWithinPartitions("id").write.mode("append").parquet(src)
        stream = ST.read_stream(spark, src, feed.schema, max_files=1_000_000)
        ST.run_available_now(ST.feed_dedupe(stream, watermark=None), f"{base}/sink", f"{base}/ckpt", rocksdb=True)
    return spark.read.parquet(f"{base}/sink").select("id", "address", "source", "price")


@register("listing_feed_dedupe_stream", with_views("demand_feed") + """
SELECT id, address, source, price FROM (
  SELECT *, row_number() OVER (PARTITION BY coalesce(address, 'id:' || CAST(id AS VARCHAR))
                               ORDER BY source, id) AS rn FROM demand_feed) x WHERE rn = 1""")
def q_feed_stream(spark, sf):
    """Feeds land one after the other, feed_a first, and the stream goes on
    from its checkpoint after each landing, so the order of arrival is given
    by the landings.  Inside a landing, rows are hash-partitioned by the dedupe
    key and sorted by id: each key's duplicates arrive in id order.  First
    arrival wins, also across the feeds.  Duplicates that arrive more than the
    watermark (a day) apart are not detected: the state forgets them."""
    base = _scratch(spark, "feed")
    src = f"{base}/source"
    key = F.coalesce(F.col("address"), F.concat(F.lit("id:"), F.col("id").cast("string")))
    for hour, name in enumerate(("feed_a", "feed_b")):
        feed = demand_feed(spark, sf).where(F.col("source") == name).withColumn(
            "ingested_at", F.timestamp_seconds(F.lit(1_735_689_600 + 3600 * hour)))
        feed.repartition(4, key).sortWithinPartitions("id").write.mode("append").parquet(src)
        stream = ST.read_stream(spark, src, feed.schema, max_files=1_000_000)
        ST.run_available_now(ST.feed_dedupe(stream), f"{base}/sink", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/sink").select("id", "address", "source", "price")


@register("listing_scoring_stream")
def q_scoring_stream(spark, sf):
    from valora.operators import spatial as SP
    from valora.plans.q_ml import _model
    res, feats = _model(spark, sf)
    store = SP.cell_feature_store(feats)
    base = _scratch(spark, "scoring")
    src = f"{base}/source"
    # new listings = the feature rows minus the cell-level lags (re-attached
    # from the store by the stream-static join)
    cols = [c for c in feats.columns if c not in ("h3_index", "h3_median_ppsf", "h3_listing_density",
                                                  "price_per_sqft")]
    feats.select(*cols).write.parquet(src)
    stream = ST.read_stream(spark, src, feats.select(*cols).schema)
    scored = ST.scoring(stream, store, res.model)
    ST.run_available_now(scored.select("id", "h3_index", "model_price", "price_delta", "valuation_status"),
                         f"{base}/sink", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/sink")


STORE_SQL = """SELECT h3_index, ROUND(median(price_per_sqft), 6) AS median_ppsf,
  ROUND(AVG(price_per_sqft), 6) AS mean_ppsf, ROUND(stddev_samp(price_per_sqft), 4) AS std_ppsf,
  COUNT(price_per_sqft) AS listing_count, ROUND(median(price), 6) AS median_price,
  median(sqft) AS median_sqft, median(bedrooms) AS median_bedrooms
FROM lcp WHERE h3_index IS NOT NULL GROUP BY h3_index"""


def _landings(spark, sf, each, base):
    """Even ids land first, then the others."""
    src = f"{base}/source"
    for rest in (0, 1):
        new = listings(spark, sf).where(F.col("id") % 2 == rest)
        new.write.mode("append").parquet(src)
        stream = ST.read_stream(spark, src, new.schema, max_files=1_000_000)
        ST.run_available_now(stream, None, f"{base}/ckpt", each=each)


@register("living_cell_store", _lv(LC, LCP) + STORE_SQL)
def q_living_store(spark, sf):
    """After two landings the store is what the batch computes from all."""
    base = _scratch(spark, "living")
    _landings(spark, sf, ST.learn(base), base)
    out = ST.current_store(spark, base)
    return out.select("h3_index", *[F.round(c, 6).alias(c) for c in ("median_ppsf", "mean_ppsf", "median_price")],
                      F.round("std_ppsf", 4).alias("std_ppsf"), "listing_count", "median_sqft", "median_bedrooms")


@register("living_store_features", _lv(LC, LCP) + """
, first_landing AS (SELECT h3_index, median(price_per_sqft) AS m, COUNT(price_per_sqft) AS n FROM lcp
  WHERE h3_index IS NOT NULL AND id % 2 = 0 GROUP BY h3_index)
SELECT l.id, l.h3_index, ROUND(coalesce(f.m, (SELECT median(m) FROM first_landing)), 6) AS h3_median_ppsf,
  CAST(coalesce(f.n, 0) AS DOUBLE) AS h3_listing_density
FROM lcp l LEFT JOIN first_landing f ON l.h3_index = f.h3_index WHERE l.id % 2 = 1""")
def q_living_features(spark, sf):
    """The second landing meets the store as the first one left it; cells that
    are new get the median of the cells."""
    base = _scratch(spark, "living")
    _landings(spark, sf, ST.score_and_learn(base, f"{base}/sink"), base)
    out = spark.read.parquet(f"{base}/sink").where("batch = 1")
    return out.select("id", "h3_index", F.round("h3_median_ppsf", 6).alias("h3_median_ppsf"), "h3_listing_density")
