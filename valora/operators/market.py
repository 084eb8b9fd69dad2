"""Market metrics over the listing table (SQL-style aggregates).

All are single-pass aggregates: Spark computes partial aggregates map-side
(HashAggregate partial -> shuffle of one row per group per task -> final),
so a hot zip code never ships its rows, only its partial state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.functions import stats as ST


def market_pulse(sales: DataFrame) -> DataFrame:
    """Days-on-market and volume summary in one scan (one output row)."""
    return sales.agg(
        F.round(F.avg("days_on_market"), 1).alias("avg_dom"),
        F.min("days_on_market").alias("min_dom"),
        F.max("days_on_market").alias("max_dom"),
        F.count(F.lit(1)).alias("total_listings"),
        F.round(F.sum("price"), 2).alias("total_volume"),
        F.round(F.avg("price"), 0).alias("avg_price"),
    )


def market_pulse_sql(spark: SparkSession, sales: DataFrame) -> DataFrame:
    """The same metric through the SQL entry point (``sales`` table text)."""
    return spark.sql(
        """SELECT ROUND(AVG(days_on_market), 1) AS avg_dom,
                  MIN(days_on_market) AS min_dom, MAX(days_on_market) AS max_dom,
                  COUNT(*) AS total_listings, ROUND(SUM(price), 2) AS total_volume,
                  ROUND(AVG(price), 0) AS avg_price
           FROM {sales}""", sales=sales)


def top_zips(sales: DataFrame, n: int = 5) -> DataFrame:
    """Zip codes by average price per sqft, descending (top-k report).

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps
    its own top n, so only n rows per task reach the final merge.
    """
    return (sales.groupBy("zip_code")
            .agg(F.round(F.avg(F.col("price") / F.col("sqft")), 0).alias("price_per_sqft"),
                 F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("price_per_sqft"), F.asc("zip_code"))
            .limit(n))


def zip_median(sales: DataFrame, col: str = "sqft") -> DataFrame:
    """Median of ``col`` per zip plus the overall median as a column."""
    zips = sales.select("zip_code").distinct()
    per_zip = ST.join_by(zips, ST.quantiles(sales, ["zip_code"], {f"zip_median_{col}": (col, 0.5)}), ["zip_code"])
    overall = ST.quantiles(sales, [], {f"overall_median_{col}": (col, 0.5)})
    return per_zip.crossJoin(F.broadcast(overall))  # 1-row side: size is proven


def zip_summary(sales: DataFrame, zip_codes: DataFrame | None = None) -> DataFrame:
    """Per-zip count/avg/median price, avg sqft, avg price per sqft.

    With ``zip_codes`` (a one-column DataFrame of requested zips) missing zips
    get the all-zero row.
    """
    # money/area means as cent-rounded sum / count: order-independent result
    agg = sales.groupBy("zip_code").agg(
        F.count(F.lit(1)).alias("count"),
        (F.round(F.sum("price"), 2) / F.count("price")).alias("avg_price"),
        (F.round(F.sum("sqft"), 2) / F.count("sqft")).alias("avg_sqft"),
        F.avg(F.col("price") / F.col("sqft")).alias("avg_price_per_sqft"),
    )
    agg = ST.join_by(agg, ST.quantiles(sales, ["zip_code"], {"median_price": ("price", 0.5)}), ["zip_code"]).select(
        "zip_code", "count", "avg_price", "median_price", "avg_sqft", "avg_price_per_sqft")
    if zip_codes is None:
        return agg
    out = zip_codes.select("zip_code").distinct().join(agg, "zip_code", "left")
    return out.select("zip_code", *[F.coalesce(F.col(c), F.lit(0)).alias(c)
                                    for c in agg.columns if c != "zip_code"])


def price_histogram(sales: DataFrame, col: str = "price", bins: int = 30) -> DataFrame:
    """Equal-width histogram: 1-row min/max (broadcast) + groupBy(bin)."""
    bounds = sales.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(col) - F.col("_lo")) / width), F.lit(bins - 1)))
    return (sales.where(F.col(col).isNotNull())
            .crossJoin(F.broadcast(bounds))
            .withColumn("bin", b.cast("bigint"))
            .groupBy("bin")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.min("_lo").alias("_lo"), F.min("_hi").alias("_hi"))
            .select("bin",
                    F.round(F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins, 2)
                    .alias("bin_start"),
                    F.round(F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins, 2)
                    .alias("bin_end"),
                    "count"))


def screener_bounds(sales: DataFrame, lo: float | None = None, hi: float | None = None,
                    zip_code: str | None = None) -> DataFrame:
    """Slider bounds, zip list, map centre and the match count in one pass."""
    match = F.lit(True)
    if lo is not None:
        match = match & (F.col("price") >= lo)
    if hi is not None:
        match = match & (F.col("price") <= hi)
    if zip_code is not None:
        match = match & (F.col("zip_code") == zip_code)
    return sales.agg(
        F.floor(F.min("price")).cast("bigint").alias("min_price"),
        F.floor(F.max("price")).cast("bigint").alias("max_price"),
        F.array_sort(F.collect_set("zip_code")).alias("zip_codes"),
        (F.round(F.sum("lat"), 6) / F.count("lat")).alias("center_lat"),
        (F.round(F.sum("lon"), 6) / F.count("lon")).alias("center_lon"),
        F.count_if(match).alias("match_count"),
    )


def distinct_zips(sales: DataFrame) -> DataFrame:
    return sales.select("zip_code").where(F.col("zip_code").isNotNull()).distinct()


def screener(df: DataFrame, lo: float, hi: float, zip_code: str | None = None,
             status: str | None = None) -> DataFrame:
    """Price range + optional zip + optional valuation status (pushed down)."""
    cond: Column = F.col("price").between(lo, hi)
    if zip_code is not None:
        cond = cond & (F.col("zip_code") == zip_code)
    if status is not None:
        cond = cond & (F.col("valuation_status") == status)
    return df.where(cond)
