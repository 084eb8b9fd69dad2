"""Dimension joins: zip demographics, static market news, neighbourhood names,
zip market statistics; and listing-feed union / dedupe / renumbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.functions import stats as ST
from valora import params as P
from valora.operators import windows

NEWS_SCHEMA = ("zip_code string, neighborhood string, sentiment string, "
               "news array<string>, risk_factors array<string>")


def market_news_table(spark: SparkSession) -> DataFrame:
    """Fixed 10-row dimension of static neighbourhood news."""
    return spark.createDataFrame(P.MARKET_NEWS, NEWS_SCHEMA)


def market_context_static(df: DataFrame, spark: SparkSession) -> DataFrame:
    """zip -> neighbourhood, sentiment, news[], risks[]; default record when
    the zip is unknown (broadcast of a fixed 10-row table)."""
    d = P.DEFAULT_MARKET_NEWS
    news = market_news_table(spark)
    j = df.join(F.broadcast(news), "zip_code", "left")
    return j.withColumns({
        "neighborhood": F.coalesce(F.col("neighborhood"), F.lit(d[0])),
        "sentiment": F.coalesce(F.col("sentiment"), F.lit(d[1])),
        "news": F.coalesce(F.col("news"), F.array(*[F.lit(x) for x in d[2]])),
        "risk_factors": F.coalesce(F.col("risk_factors"), F.array(*[F.lit(x) for x in d[3]])),
    })


def neighborhood_name(zip_col: str = "zip_code"):
    """zip -> neighbourhood name from a literal map; default name otherwise."""
    m = F.create_map(*[x for z, name, *_ in P.MARKET_NEWS for x in (F.lit(z), F.lit(name))])
    return F.coalesce(m[F.col(zip_col)], F.lit(P.DEFAULT_NEIGHBORHOOD))


def zip_enrich(df: DataFrame, zip_dim: DataFrame) -> DataFrame:
    """Left join of zip demographics (one row per zip).  No hint: AQE sees
    the dimension's runtime size and broadcasts it when it is under
    ``spark.sql.autoBroadcastJoinThreshold``, else keeps a shuffle join."""
    return df.join(zip_dim, "zip_code", "left")


def zip_market_stats(listings: DataFrame) -> DataFrame:
    """Per-zip market statistics table: median sale price, median $/sqft,
    homes sold."""
    rows = listings.where(F.col("zip_code").isNotNull())
    med = ST.quantiles(rows, ["zip_code"], {
        "median_sale_price": ("price", 0.5),
        "median_ppsf": (F.col("price") / F.nullif(F.col("sqft"), F.lit(0.0)), 0.5)})
    sold = rows.groupBy("zip_code").agg(F.count(F.lit(1)).alias("homes_sold"))
    return sold.join(med, "zip_code", "left").select("zip_code", "median_sale_price", "median_ppsf", "homes_sold")


def region_to_zip(region_col: str = "REGION"):
    """'Zip Code: 94107' -> '94107' (first 5-digit group); no match -> NULL."""
    z = F.regexp_extract(F.col(region_col), r"(\d{5})", 1)
    return F.when(z == "", F.lit(None).cast("string")).otherwise(z)


# ------------------------------------------------------------------ feeds

def union_sources(*frames: DataFrame) -> DataFrame:
    """Concatenate per-source frames by column name (missing -> NULL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def dedupe_keep_first(df: DataFrame, key: str = "address", order=("source", "id")) -> DataFrame:
    """First row per address (explicit order); NULL-address rows are all kept.

    ``min_by(struct(all columns), order)`` per address: a partial aggregate,
    so even an address repeated across a third of the feed only ships one
    partial row per task (no per-key window).
    """
    cols = df.columns
    keyed = df.where(F.col(key).isNotNull())
    order_key = F.struct(*[F.col(c) for c in order])
    firsts = (keyed.groupBy(key)
              .agg(F.min_by(F.struct(*[F.col(c) for c in cols]), order_key).alias("_r"))
              .select("_r.*"))
    return firsts.unionByName(df.where(F.col(key).isNull()))


def renumber_ids(df: DataFrame, order_col: str, out_col: str = "id") -> DataFrame:
    """ids 1..n in ``order_col`` order, via the bucketed global row number
    (no single-partition window over all rows)."""
    tmp = "_row_id"
    out = windows.global_row_number(df, order_col, tmp)
    if out_col in out.columns:
        out = out.drop(out_col)
    return out.withColumnRenamed(tmp, out_col)
