"""Driver tables and the domain views derived from them.

The valuation domain (listings, AI audit log, demand feed) is derived from
the TPC-H-like driver tables by deterministic SQL.  The same text runs on
Spark (``spark.sql`` with DataFrame arguments, so no global view names are
touched) and on DuckDB (oracle side, as a CTE).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan of one driver table (column pruning/pushdown apply)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Listing view: one listing per order.  Nulls in sqft (1/17) and condition
# (1/23) exercise imputation.
LISTINGS_SQL = """
SELECT id,
  CAST(37.70 AS DOUBLE) + CAST(0.0042 AS DOUBLE) * zi + CAST(0.00001 AS DOUBLE) * ((id * 101) % 997) AS lat,
  CAST(-122.50 AS DOUBLE) + CAST(0.0050 AS DOUBLE) * ((zi * 11) % 28) + CAST(0.00001 AS DOUBLE) * ((id * 211) % 991) AS lon,
  CAST(400000 AS DOUBLE) + sqft_full * 450 + bedrooms * 75000 + (year_built - 1950) * 1500
    + cond_full * 40000 + (zi - 14) * 20000 + (o_totalprice % CAST(100000 AS DOUBLE)) - 50000 AS price,
  CASE WHEN id % 17 = 0 THEN NULL ELSE sqft_full END AS sqft,
  bedrooms, year_built,
  CONCAT('941', LPAD(CAST(zi AS VARCHAR(10)), 2, '0')) AS zip_code,
  CASE WHEN id % 23 = 0 THEN NULL ELSE cond_full END AS condition,
  CAST(1 + (id * 37) % 180 AS INT) AS days_on_market
FROM (
  SELECT o_orderkey AS id, o_totalprice,
    CAST(600 + (o_orderkey * 7919) % 4400 AS DOUBLE) AS sqft_full,
    CAST(1 + o_custkey % 5 AS INT) AS bedrooms,
    CAST(1900 + (o_orderkey * 31) % 124 AS INT) AS year_built,
    CAST(1 + (o_orderkey * 13 + o_custkey) % 5 AS INT) AS cond_full,
    CAST(o_custkey % 28 AS INT) AS zi
  FROM {orders}) b
"""

AUDIT_LOG_SQL = """
SELECT event_id AS id, ts AS timestamp, user_id AS property_id,
  SUBSTRING(event_type, 1, 16) AS prompt_hash,
  CASE WHEN user_id % 3 = 0 THEN 'gpt-4o-mini' WHEN user_id % 3 = 1 THEN 'gpt-4o' ELSE 'unknown-model' END AS model,
  CAST(100 + (event_id * 37) % 4000 AS BIGINT) AS input_tokens,
  CAST(20 + (event_id * 13) % 600 AS BIGINT) AS output_tokens,
  event_type <> 'error' AS success,
  CAST(50 + (event_id * 71) % 3000 AS BIGINT) AS latency_ms
FROM {events}
"""

DEMAND_FEED_SQL = """
SELECT c_custkey AS id,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CONCAT('ADDR-', CAST(c_custkey % 401 AS VARCHAR(10))) END AS address,
  CASE WHEN c_custkey % 2 = 0 THEN 'feed_a' ELSE 'feed_b' END AS source,
  c_acctbal AS price
FROM {customer}
"""


# Raw (dirty) listing feed from customers: out-of-range coordinates,
# negative prices, future build years, bad bedrooms/condition, NULLs --
# the input of the validation operators.
RAW_LISTINGS_SQL = """
SELECT c_custkey AS id,
  CAST((c_custkey % 200) - 100 AS DOUBLE) AS lat,
  CAST((c_custkey * 7) % 400 - 200 AS DOUBLE) AS lon,
  c_acctbal * 100 AS price,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST((c_custkey * 37) % 60000 AS DOUBLE) END AS sqft,
  c_nationkey AS bedrooms,
  CAST(1790 + (c_custkey * 13) % 240 AS INT) AS year_built,
  CONCAT('941', LPAD(CAST(c_nationkey AS VARCHAR(10)), 2, '0')) AS zip_code,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey % 7 AS INT) END AS condition
FROM {customer}
"""


# Zip demographics dimension (one row per zip) from nation/region/customer.
ZIP_DIM_SQL = """
SELECT CONCAT('941', LPAD(CAST(n.n_nationkey AS VARCHAR(10)), 2, '0')) AS zip_code,
  n.n_name AS city, r.r_name AS county, 'CA' AS state,
  CAST(COUNT(c.c_custkey) * 1000 AS BIGINT) AS population,
  ROUND(COUNT(c.c_custkey) * CAST(1000 AS DOUBLE) / CAST(7 AS DOUBLE), 2) AS population_density,
  ROUND(SUM(c.c_acctbal), 2) * 20 / COUNT(c.c_custkey) AS median_household_income
FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN {customer} c ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_nationkey, n.n_name, r.r_name
"""


def oracle_cte(name: str) -> str:
    """SQL text of a derived view for the DuckDB oracle (raw tables as views)."""
    text = {"listings": LISTINGS_SQL, "ai_audit_log": AUDIT_LOG_SQL,
            "demand_feed": DEMAND_FEED_SQL, "raw_listings": RAW_LISTINGS_SQL,
            "zip_dim": ZIP_DIM_SQL}[name]
    for t in ("orders", "events", "customer", "nation", "region"):
        text = text.replace("{%s}" % t, t)
    return text


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LISTINGS_SQL, orders=table(spark, sf_dir, "orders"))


def ai_audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit log; ``timestamp`` stays TIMESTAMP_NTZ (UTC wall time)."""
    return spark.sql(AUDIT_LOG_SQL, events=table(spark, sf_dir, "events"))


def demand_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DEMAND_FEED_SQL, customer=table(spark, sf_dir, "customer"))


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW_LISTINGS_SQL, customer=table(spark, sf_dir, "customer"))


def zip_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ZIP_DIM_SQL, nation=table(spark, sf_dir, "nation"),
                     region=table(spark, sf_dir, "region"),
                     customer=table(spark, sf_dir, "customer"))
