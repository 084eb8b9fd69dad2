"""Sources and sinks: listing files, the ``sales`` table, landed JSON feed
payloads, market statistics and walk-score responses, chunk-store upkeep.

Network clients of the original (listing APIs, walk-score API) are out of
scope; their responses are landed as JSON strings and parsed here with
``from_json`` + ``inline`` (JVM-side, no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valora import params as P

LISTING_FILE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()), T.StructField("price", T.DoubleType()),
    T.StructField("sqft", T.DoubleType()), T.StructField("bedrooms", T.IntegerType()),
    T.StructField("year_built", T.IntegerType()), T.StructField("zip_code", T.StringType()),
    T.StructField("condition", T.IntegerType()), T.StructField("days_on_market", T.IntegerType()),
])

MARKET_STATS_SCHEMA = T.StructType([
    T.StructField("zip_code", T.StringType()), T.StructField("MEDIAN_SALE_PRICE", T.DoubleType()),
    T.StructField("MEDIAN_PPSF", T.DoubleType()), T.StructField("HOMES_SOLD", T.LongType()),
])


# ------------------------------------------------------------------ S1-S5

def read_listings_csv(spark: SparkSession, path: str, schema: T.StructType = LISTING_FILE_SCHEMA) -> DataFrame:
    """CSV scan with an explicit schema (zip codes stay strings)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_listings_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def land_feed(payloads: DataFrame, path: str) -> None:
    """Land feed responses (provider, zip_code, payload): one line of JSON each,
    in folders by provider and zip."""
    (payloads.select("provider", "zip_code", "payload").write.mode("append").partitionBy("provider", "zip_code").text(path))


def read_listings_feed(spark: SparkSession, path: str) -> DataFrame:
    """Listings of landed feed responses of both providers, in the columns of
    the listing files (NULL where a provider has none).  A filter on zip_code
    prunes the folders."""
    pages = spark.read.schema("value string, provider string, zip_code string").text(path)
    pages = pages.withColumnRenamed("zip_code", "page_zip")
    parsed = [parse(pages.where(F.col("provider") == name), "value", keep=("page_zip",)).drop("zip_code")
              .withColumnRenamed("page_zip", "zip_code") for name, parse in (("a", parse_payload_a), ("b", parse_payload_b))]
    both = parsed[0].unionByName(parsed[1], allowMissingColumns=True)
    have = set(both.columns)
    return both.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in LISTING_FILE_SCHEMA.fields])


READERS = {"csv": read_listings_csv, "parquet": read_listings_parquet, "feed": read_listings_feed}


def source_priority(spark: SparkSession, candidates: list[tuple[str, str]],
                    force: str | None = None) -> DataFrame:
    """First existing source wins: ``candidates`` = [(format, path), ...] in
    priority order, a format of READERS; ``force`` picks a format regardless
    of order.  One lazy read of the winner."""
    order = [c for c in candidates if force is None or c[0] == force]
    for fmt, path in order:
        if exists(spark, path):
            return READERS[fmt](spark, path)
    raise FileNotFoundError(f"no listing source found among {candidates}")


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


# ------------------------------------------------------------------ S6

SALES_BUCKETS = 32


def sales_table(df: DataFrame, name: str = "sales", path: str | None = None) -> DataFrame:
    """Replace the ``sales`` table: a temporary view, or with ``path`` a table
    of the catalogue whose files lie there.

    It stands for the original's table with two indexes: bucketed by zip_code
    (a lookup reads one bucket), sorted by zip_code, price and id inside a
    file, so that row groups prune price ranges, and with Parquet bloom
    filters on id.  Rows come range-partitioned by the same keys, so a large zip
    is spread over many files of its bucket."""
    spark = df.sparkSession
    spark.catalog.dropTempView(name)  # a view would hide the table
    if path is None:
        df.createOrReplaceTempView(name)
        return df
    keys = [c for c in ("zip_code", "price", "id") if c in df.columns]
    w = df.repartitionByRange(*keys).write.mode("overwrite").format("parquet").option("path", path)
    if "id" in df.columns:
        w = w.option("parquet.bloom.filter.enabled#id", "true")
    if "zip_code" in df.columns:
        w = w.bucketBy(SALES_BUCKETS, "zip_code").sortBy(*keys)
    w.saveAsTable(name)
    return spark.table(name)


def execute_sql(spark: SparkSession, query: str) -> DataFrame:
    return spark.sql(query)


# ------------------------------------------------------------------ S7, S8

PAYLOAD_A_SCHEMA = ("struct<props: array<struct<zpid: bigint, latitude: double, longitude: double, "
                    "price: double, livingArea: double, bedrooms: int, bathrooms: double, yearBuilt: int, "
                    "address: struct<zipcode: string, streetAddress: string>, propertyType: string, "
                    "daysOnZillow: int>>>")
PAYLOAD_B_SCHEMA = ("struct<data: struct<results: array<struct<propertyId: bigint, "
                    "latLong: struct<latitude: double, longitude: double>, priceInfo: struct<amount: double>, "
                    "sqftInfo: struct<amount: double>, beds: int, yearBuilt: int, postalCode: string>>>>")


def _listed(items: Column, limit: int | None) -> Column:
    """One row per listing of a payload; ``limit`` is the caller's page size."""
    return F.inline(items if limit is None else F.slice(items, 1, limit))


def parse_payload_a(df: DataFrame, col: str = "payload", limit: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """props -> 12 listing columns; absent keys -> NULL.  ``keep``: columns of
    ``df`` that come along."""
    p = F.from_json(F.col(col), PAYLOAD_A_SCHEMA)
    rows = df.select(*keep, _listed(p["props"], limit))
    return rows.select(
        *keep,
        F.col("zpid").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
        "price", F.col("livingArea").alias("sqft"), "bedrooms", "bathrooms",
        F.col("yearBuilt").alias("year_built"), F.col("address.zipcode").alias("zip_code"),
        F.col("address.streetAddress").alias("address"), F.col("propertyType").alias("property_type"),
        F.col("daysOnZillow").alias("days_on_market"))


def parse_payload_b(df: DataFrame, col: str = "payload", limit: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """data.results -> 8 listing columns.  ``keep``: as above."""
    p = F.from_json(F.col(col), PAYLOAD_B_SCHEMA)
    rows = df.select(*keep, _listed(p["data"]["results"], limit))
    return rows.select(
        *keep,
        F.col("propertyId").alias("id"), F.col("latLong.latitude").alias("lat"),
        F.col("latLong.longitude").alias("lon"), F.col("priceInfo.amount").alias("price"),
        F.col("sqftInfo.amount").alias("sqft"), F.col("beds").alias("bedrooms"),
        F.col("yearBuilt").alias("year_built"), F.col("postalCode").alias("zip_code"))


# ------------------------------------------------------------------ S9

def read_market_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MARKET_STATS_SCHEMA).option("header", True).csv(path)


# ------------------------------------------------------------------ S11

WALKSCORE_SCHEMA = ("struct<status: int, walkscore: int, description: string, ws_link: string, "
                    "logo_url: string, transit: string, bike: string>")


def parse_walkscore(df: DataFrame, col: str = "payload") -> DataFrame:
    """Landed walk-score response -> scores, link, description, error.
    status != 1 -> NULL scores + message; transit / bike only when objects."""
    p = F.from_json(F.col(col), WALKSCORE_SCHEMA)
    status = F.coalesce(p["status"], F.lit(0))
    ok = status == 1
    msgs = F.create_map(*[x for k, v in P.WALKSCORE_STATUS.items() for x in (F.lit(k), F.lit(v))])
    err = F.coalesce(msgs[status], F.concat(F.lit("Unknown status "), status.cast("string")))

    def sub(obj: Column, key: str) -> Column:
        is_obj = F.startswith(F.ltrim(obj), F.lit("{"))
        return F.when(is_obj, F.get_json_object(obj, f"$.{key}"))
    return df.withColumns({
        "walk_score": F.when(ok, p["walkscore"]),
        "transit_score": F.when(ok, sub(p["transit"], "score").cast("int")),
        "bike_score": F.when(ok, sub(p["bike"], "score").cast("int")),
        "ws_link": p["ws_link"],
        "logo_url": F.when(ok, p["logo_url"]),
        "description": F.when(ok, p["description"]),
        "transit_description": F.when(ok, sub(p["transit"], "description")),
        "bike_description": F.when(ok, sub(p["bike"], "description")),
        "error": F.when(~ok, err),
    })


# ------------------------------------------------------------------ S13

def seed_chunk_store(store_path: str, seed: DataFrame) -> DataFrame:
    """Append seed chunks whose id is not in the store yet (left_anti)."""
    spark = seed.sparkSession
    if exists(spark, store_path):
        have = spark.read.parquet(store_path).select("id")
        new = seed.join(have, "id", "left_anti")
    else:
        new = seed
    new.write.mode("append").parquet(store_path)
    return spark.read.parquet(store_path)


def clear_chunk_store(store_path: str, schema: T.StructType) -> DataFrame:
    """Drop and recreate as empty."""
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(store_path)
    return spark.read.parquet(store_path)
