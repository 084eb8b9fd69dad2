"""Structured Streaming jobs.

ST1 audit roll-up.  ``audit_rollup``: event-time tumbling 1-day windows with a
1-hour watermark; a window is emitted (append mode) once the watermark passes
its end, rows arriving later for it are discarded.  ``rollup_merge``: each
batch adds its sums by day to a table, and rows of days that were closed before
the batch began go to a side table, so that nothing vanishes.
ST2 listing-feed dedupe on ``coalesce(address, 'id:' || id)``: first arrival
wins; rows without an address are never merged with each other.  Keys are
remembered for a time (``dropDuplicatesWithinWatermark``) or for ever
(``dropDuplicates``; the state is kept by RocksDB, on disk).
ST3 listing scoring: join of new listings to the cell feature store (one row
per cell; join strategy left to the planner) and an MLlib model transform.  The
store is alive: ``learn`` adds each batch to it.

Functions for ``foreachBatch`` name what they write by the batch id and
overwrite it, so a batch that is run again after a failure leaves the same.

Sources are file streams (Parquet directories), sinks are chosen by the
caller; tests drive them with ``trigger(availableNow=True)`` into Parquet
sinks under the session's checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from valora.functions import stats as ST
from valora.operators import spatial as SP
from valora.operators import valuation as VA
from valora.session import stage
from valora.sources import io as IO


def read_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 64) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .parquet(path))


def audit_rollup(stream: DataFrame, ts_col: str = "timestamp", watermark: str = "1 hour",
                 window: str = "1 day") -> DataFrame:
    """Per UTC day: calls, successes, cost, avg latency, token sums."""
    s = stream.withColumn("_ts", F.col(ts_col).cast("timestamp")).withWatermark("_ts", watermark)
    return (s.groupBy(F.window("_ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(F.when(F.col("success"), 1).otherwise(0)).alias("successful_calls"),
        F.sum("cost_estimate").alias("total_cost"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"))
        .select(F.to_date(F.col("w.start")).alias("day"), "calls", "successful_calls",
                "total_cost", "avg_latency_ms", "input_tokens", "output_tokens"))


DAYS = ("day date, late boolean, calls long, successful_calls long, total_cost double, latency_sum double, latency_n long, "
        "input_tokens long, output_tokens long, newest timestamp, batch long")


def _written(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The batches written so far; empty if there are none."""
    return spark.read.schema(schema).parquet(path) if IO.exists(spark, path) else spark.createDataFrame([], schema)


def rollup_merge(base: str, ts_col: str = "timestamp", watermark: str = "1 hour") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: sums by day under ``base/days``, late rows as they
    are under ``base/late``.  A row is late if its day had ended at least
    ``watermark`` before the newest row of the earlier batches."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = _written(spark, f"{base}/days", DAYS).where(F.col("batch") < batch_id)
        newest = earlier.agg(F.max("newest")).first()[0]  # one row
        ts = F.col(ts_col).cast("timestamp")
        end = F.to_date(ts).cast("timestamp") + F.expr("INTERVAL 1 DAY")
        late = F.lit(False) if newest is None else end <= F.lit(newest) - F.expr(f"INTERVAL {watermark}")
        rows = batch.withColumns({"day": F.to_date(ts), "late": F.coalesce(late, F.lit(False))})
        (rows.groupBy("day", "late").agg(
            F.count(F.lit(1)).alias("calls"), F.count_if(F.col("success")).alias("successful_calls"),
            F.sum("cost_estimate").alias("total_cost"), F.sum("latency_ms").cast("double").alias("latency_sum"),
            F.count("latency_ms").alias("latency_n"), F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"), F.max(ts).alias("newest"))
         .write.mode("overwrite").parquet(f"{base}/days/batch={batch_id}"))
        rows.where("late").drop("day", "late").write.mode("overwrite").parquet(f"{base}/late/batch={batch_id}")
    return merge


def rollup_table(spark: SparkSession, base: str) -> DataFrame:
    """Per UTC day all that has arrived, and how much of it was late."""
    return _written(spark, f"{base}/days", DAYS).groupBy("day").agg(
        F.sum("calls").alias("calls"), F.coalesce(F.sum(F.when(F.col("late"), F.col("calls"))), F.lit(0)).alias("late_calls"),
        F.sum("successful_calls").alias("successful_calls"), F.sum("total_cost").alias("total_cost"),
        F.try_divide(F.sum("latency_sum"), F.sum("latency_n")).alias("avg_latency_ms"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def feed_dedupe(stream: DataFrame, ts_col: str = "ingested_at", watermark: str | None = "1 day") -> DataFrame:
    """First arrival of each key.  ``watermark``: how long a key is remembered;
    None remembers it for ever, one key a listing, which suits RocksDB
    (``run_available_now(..., rocksdb=True)``)."""
    key = F.coalesce(F.col("address"), F.concat(F.lit("id:"), F.col("id").cast("string")))
    if watermark is None:
        return stream.withColumn("_key", key).dropDuplicates(["_key"]).drop("_key")
    s = stream.withColumn("_ts", F.col(ts_col).cast("timestamp")).withColumn("_key", key)
    return s.withWatermark("_ts", watermark).dropDuplicatesWithinWatermark(["_key"]).drop("_key", "_ts")


def with_cell_features(rows: DataFrame, feature_store: DataFrame, unknown: float | None = None) -> DataFrame:
    """New listings with the statistics of their cell; cells that the store
    doesn't have get ``unknown`` as median and a density of 0 (NULL without it)."""
    s = SP.add_cell_index(rows)
    fs = feature_store.select("h3_index", F.col("median_ppsf").alias("h3_median_ppsf"),
                              F.col("listing_count").cast("double").alias("h3_listing_density"))
    # the store has one row per occupied cell: its size follows the covered
    # area, not a fixed bound, so the planner picks broadcast vs shuffle
    j = s.join(fs, "h3_index", "left")
    if unknown is not None:
        j = j.withColumns({"h3_median_ppsf": F.coalesce("h3_median_ppsf", F.lit(unknown)),
                           "h3_listing_density": F.coalesce("h3_listing_density", F.lit(0.0))})
    return j


def scoring(rows: DataFrame, feature_store: DataFrame, model: PipelineModel, unknown: float | None = None) -> DataFrame:
    """Join each new listing to its cell statistics, predict, add status."""
    j = with_cell_features(rows, feature_store, unknown)
    scored = model.transform(j).withColumnRenamed("prediction", "model_price").drop("features")
    return VA.valuation_status(scored)


# ------------------------------------------------------------------ ST3: the living store

#: metric m of the state is the m-th of these columns
STORE_METRICS = ["price_per_sqft", "price", "sqft", "bedrooms"]
STATE = "h3_index string, m int, v double, c long, batch long, bucket int"
STORE = ("h3_index string, mean_ppsf double, std_ppsf double, listing_count long, mean_price double, median_ppsf double, "
         "median_price double, median_sqft double, median_bedrooms double")
STATE_BUCKETS = 64


def learn(base: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: adds listings with a price to the cell store under
    ``base``.

    The state is mergeable and exact: how often each value of a metric occurs
    in a cell.  A batch appends its counts, in buckets by cell; then the cells
    that it touches (and no others) are computed anew from the counts of their
    buckets and appended to the store, in which the latest row of a cell holds.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = SP._ensure_ppsf(batch).where(F.col("h3_index").isNotNull())
        pairs = F.array(*[F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("v")) for i, c in enumerate(STORE_METRICS)])
        counts = (rows.select("h3_index", F.inline(pairs)).where("v is not null").groupBy("h3_index", "m", "v")
                  .agg(F.count(F.lit(1)).alias("c")).withColumn("bucket", F.pmod(F.xxhash64("h3_index"), F.lit(STATE_BUCKETS)).cast("int")))
        counts.write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/state/batch={batch_id}")
        state = _written(spark, f"{base}/state", STATE).where(F.col("batch") <= batch_id)
        touched = state.where(F.col("batch") == batch_id).select("h3_index", "bucket").distinct()
        buckets = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # STATE_BUCKETS numbers at most
        mine = state.where(F.col("bucket").isin(buckets)).join(touched.select("h3_index"), "h3_index", "left_semi")
        store_of_counts(mine).write.mode("overwrite").parquet(f"{base}/store/batch={batch_id}")
    return merge


def store_of_counts(state: DataFrame) -> DataFrame:
    """The cell feature store from value counts (h3_index, m, v, c)."""
    counts = stage(state.groupBy("h3_index", "m", "v").agg(F.sum("c").alias("c")), "store_counts")
    means = counts.groupBy("h3_index", "m").agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    ppsf = F.col("m") == 0
    gap = F.col("v") - F.col("mean")
    spread = (counts.where(ppsf).join(means, ["h3_index", "m"])
              .groupBy("h3_index").agg(F.when(F.max("n") > 1, F.sqrt(F.sum(F.col("c") * gap * gap) / (F.max("n") - 1))).alias("std_ppsf")))
    sums = means.groupBy("h3_index").agg(
        F.max(F.when(ppsf, F.col("mean"))).alias("mean_ppsf"), F.coalesce(F.max(F.when(ppsf, F.col("n"))), F.lit(0)).alias("listing_count"),
        F.max(F.when(F.col("m") == 1, F.col("mean"))).alias("mean_price"))
    medians = ST.quantiles_of_counts(counts, ["h3_index"], {
        f"median_{name}": (m, 0.5) for m, name in enumerate(("ppsf", "price", "sqft", "bedrooms"))})
    return (sums.join(spread, "h3_index", "left").join(medians, "h3_index", "left")
            .select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in STORE.split(", ")]))


def current_store(spark: SparkSession, base: str, before: int | None = None) -> DataFrame:
    """The living store, as it is or as it was before a batch: the latest row
    of each cell."""
    rows = _written(spark, f"{base}/store", STORE + ", batch long")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    cols = [c.split()[0] for c in STORE.split(", ")]
    latest = F.max_by(F.struct(*cols), "batch").alias("r")
    return rows.groupBy(F.col("h3_index").alias("cell")).agg(latest).select("r.*")


def unknown_cell(store: DataFrame) -> float | None:
    """What a cell without listings is taken for: the median of the cells."""
    return ST.quantiles(store, [], {"q": ("median_ppsf", 0.5)}).first()["q"]


def score_and_learn(base: str, sink: str, model: PipelineModel | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: listings are joined to the store as the earlier
    batches left it (and scored, with a model), written under ``sink``, and then
    learned."""
    add = learn(base)

    def run(batch: DataFrame, batch_id: int) -> None:
        store = current_store(batch.sparkSession, base, before=batch_id)
        unknown = unknown_cell(store)
        out = with_cell_features(batch, store, unknown) if model is None else scoring(batch, store, model, unknown)
        out.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        add(batch, batch_id)
    return run


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available_now(df: DataFrame, sink_path: str | None, checkpoint: str, mode: str = "append",
                      fmt: str = "parquet", each: Callable[[DataFrame, int], None] | None = None, rocksdb: bool = False):
    """Drive a streaming query over everything available, then stop.  ``each``
    gets the batches instead of a sink; ``rocksdb`` keeps the state there."""
    conf, key = df.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    w = w.format(fmt).option("path", sink_path) if each is None else w.foreachBatch(each)
    try:
        if rocksdb:  # a query takes the setting over when it starts
            conf.set(key, ROCKSDB)
        q = w.start()
    finally:
        conf.set(key, before)
    q.awaitTermination()
    return q
