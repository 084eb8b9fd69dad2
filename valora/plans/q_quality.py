"""Validation, imputation and quality queries (P1, P5, V1-V3, I1-I2, A8, A9,
S1-S6, W4, W5, U1, U2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from valora.operators import quality as QU
from valora.plans.catalog import register, with_views
from valora.sources.tables import listings, raw_listings

LV = with_views("listings")
RV = with_views("raw_listings")


def r6(c):
    return F.round(c, 6)


@register("clean_column_names", LV + """
SELECT id, price AS sale_price, year_built AS year_built, zip_code AS zip_code,
  days_on_market AS days_on_market FROM listings""")
def q_clean_names(spark, sf):
    raw = listings(spark, sf).select(
        F.col("id").alias(" ID "), F.col("price").alias("  Sale Price ($) "),
        F.col("year_built").alias("Year--Built"), F.col("zip_code").alias("ZIP Code"),
        F.col("days_on_market").alias("Days_On__Market_"))
    return QU.clean_column_names(raw)


@register("critical_constraints", RV + """
SELECT (SELECT COUNT(*) FROM raw_listings WHERE price < 0) AS negative_price_count,
  (SELECT COUNT(*) FROM raw_listings WHERE year_built > 2025) AS future_year_count,
  (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FROM
     (SELECT id FROM raw_listings WHERE price < 0 ORDER BY id LIMIT 10) a) AS negative_price_ids,
  (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FROM
     (SELECT id FROM raw_listings WHERE year_built > 2025 ORDER BY id LIMIT 10) b) AS future_year_ids""")
def q_critical(spark, sf):
    out = QU.critical_constraint_counts(raw_listings(spark, sf))
    return out.select("negative_price_count", "future_year_count",
                      F.array_join("negative_price_ids", ",").alias("negative_price_ids"),
                      F.array_join("future_year_ids", ",").alias("future_year_ids"))


_V2 = [
    ("id", "not_null_ge_0", "id IS NULL OR id < 0"),
    ("lat", "in_range(-90,90)", "lat < -90 OR lat > 90"),
    ("lon", "in_range(-180,180)", "lon < -180 OR lon > 180"),
    ("price", "in_range(0,100000000)", "price IS NULL OR price < 0 OR price > 100000000"),
    ("sqft", "in_range(100,50000)", "sqft < 100 OR sqft > 50000"),
    ("bedrooms", "in_range(0,20)", "bedrooms IS NULL OR bedrooms < 0 OR bedrooms > 20"),
    ("year_built", "in_range(1800,2025)", "year_built IS NULL OR year_built < 1800 OR year_built > 2025"),
    ("condition", "in_range(1,5)", "condition IS NULL OR condition < 1 OR condition > 5"),
]


def _v2_sql():
    parts = []
    for col, chk, cond in _V2:
        val = {"id": "CAST(id AS VARCHAR)", "bedrooms": "CAST(bedrooms AS VARCHAR)",
               "year_built": "CAST(year_built AS VARCHAR)", "condition": "CAST(condition AS VARCHAR)"}
        v = val.get(col, f"CAST({col} AS VARCHAR)")
        parts.append(f"SELECT id, '{col}' AS \"column\", '{chk}' AS \"check\", {v} AS value "
                     f"FROM raw_listings WHERE coalesce({cond}, false)")
    return RV + "\nUNION ALL\n".join(parts)


@register("schema_violations", _v2_sql())
def q_schema_violations(spark, sf):
    return QU.schema_violations(raw_listings(spark, sf))


@register("raw_schema_check", RV + """
SELECT id, 'price' AS "column", 'ge(0)' AS "check", CAST(price AS VARCHAR) AS value FROM raw_listings WHERE price < 0
UNION ALL
SELECT id, 'year_built', 'le(2025)', CAST(year_built AS VARCHAR) FROM raw_listings WHERE year_built > 2025""")
def q_raw_schema_check(spark, sf):
    return QU.raw_schema_check(raw_listings(spark, sf))


@register("impute_sqft", LV + """
, zm AS (SELECT zip_code, median(sqft) AS m FROM listings WHERE zip_code IS NOT NULL GROUP BY zip_code),
om AS (SELECT median(sqft) AS m FROM listings)
SELECT l.id, coalesce(l.sqft, zm.m, om.m) AS sqft, l.sqft IS NULL AS sqft_imputed
FROM listings l LEFT JOIN zm ON l.zip_code = zm.zip_code, om""".replace("\n, zm AS", ", zm AS", 1))
def q_impute_sqft(spark, sf):
    return QU.impute_sqft(listings(spark, sf)).select("id", "sqft", "sqft_imputed")


@register("impute_condition", LV + """
SELECT id, CAST(coalesce(condition, CASE WHEN 2025 - year_built < 10 THEN 5 WHEN 2025 - year_built < 25 THEN 4
  WHEN 2025 - year_built < 50 THEN 3 WHEN 2025 - year_built < 75 THEN 2 ELSE 1 END) AS INTEGER) AS condition
FROM listings""")
def q_impute_condition(spark, sf):
    return QU.impute_condition(listings(spark, sf)).select("id", "condition")


def _qr_sql():
    cols = [("id", "bigint", True), ("lat", "double", True), ("lon", "double", True),
            ("price", "double", True), ("sqft", "double", True), ("bedrooms", "int", True),
            ("year_built", "int", True), ("zip_code", "string", False),
            ("condition", "int", True), ("days_on_market", "int", True)]
    parts = []
    for c, t, num in cols:
        x = f"CAST({c} AS DOUBLE)"
        stats = (f"MIN({x}), MAX({x}), ROUND(SUM({x}), 6) / COUNT({x}), median({x}), ROUND(stddev_samp({x}), 4)"
                 if num else "NULL, NULL, NULL, NULL, NULL")
        parts.append(f"SELECT COUNT(*) AS total_records, '{c}' AS \"column\", '{t}' AS dtype, "
                     f"COUNT(*) - COUNT({c}) AS null_count, "
                     f"ROUND((COUNT(*) - COUNT({c})) * CAST(100 AS DOUBLE) / COUNT(*), 6) AS null_pct, {stats} FROM listings")
    body = "\nUNION ALL\n".join(parts)
    return LV + f"""SELECT total_records, "column", dtype, null_count, null_pct,
  CAST(mn AS DOUBLE) AS "min", CAST(mx AS DOUBLE) AS "max", CAST(mean AS DOUBLE) AS mean,
  CAST(med AS DOUBLE) AS median, CAST(sd AS DOUBLE) AS std
FROM ({body}) t(total_records, "column", dtype, null_count, null_pct, mn, mx, mean, med, sd)"""


@register("quality_report", _qr_sql())
def q_quality_report(spark, sf):
    out = QU.quality_report(listings(spark, sf))
    return out.select("total_records", "column", "dtype", "null_count",
                      r6(F.col("null_pct")).alias("null_pct"), "min", "max", "mean", "median",
                      F.round("std", 4).alias("std"))


@register("quantile_bounds", LV + """
SELECT ROUND(quantile_cont(price, 0.05), 6) AS price_p05, ROUND(quantile_cont(price, 0.95), 6) AS price_p95,
  ROUND(quantile_cont(sqft, 0.05), 6) AS sqft_p05, ROUND(quantile_cont(sqft, 0.95), 6) AS sqft_p95,
  ROUND(quantile_cont(price / NULLIF(sqft, 0), 0.05), 6) AS price_per_sqft_p05,
  ROUND(quantile_cont(price / NULLIF(sqft, 0), 0.95), 6) AS price_per_sqft_p95
FROM listings""")
def q_quantile_bounds(spark, sf):
    from valora.operators.features import price_per_sqft
    b = QU.quantile_bounds(price_per_sqft(listings(spark, sf)))
    return b.select(*[r6(F.col(c)).alias(c) for c in b.columns])


@register("outlier_reasons", LV + """
, lp AS (SELECT *, price / NULLIF(sqft, 0) AS ppsf FROM listings),
b AS (SELECT quantile_cont(price, 0.05) AS p05, quantile_cont(price, 0.95) AS p95,
  quantile_cont(sqft, 0.05) AS s05, quantile_cont(sqft, 0.95) AS s95,
  quantile_cont(ppsf, 0.05) AS f05, quantile_cont(ppsf, 0.95) AS f95 FROM lp)
SELECT id, CASE WHEN r = '' THEN 'Multivariate anomaly' ELSE r END AS reason FROM (
  SELECT id, concat_ws('; ',
    CASE WHEN price > p95 THEN 'Price > 95th pct ($' || format('{:,.0f}', p95) || ')'
         WHEN price < p05 THEN 'Price < 5th pct ($' || format('{:,.0f}', p05) || ')' END,
    CASE WHEN ppsf > f95 THEN '$/sqft > 95th pct' WHEN ppsf < f05 THEN '$/sqft < 5th pct' END,
    CASE WHEN sqft > s95 THEN 'Sqft > 95th pct (' || format('{:,.0f}', s95) || ')'
         WHEN sqft < s05 THEN 'Sqft < 5th pct (' || format('{:,.0f}', s05) || ')' END) AS r
  FROM lp, b) x""".replace("\n, lp AS", ", lp AS", 1))
def q_outlier_reasons(spark, sf):
    from valora.operators.features import price_per_sqft
    return QU.outlier_reasons(price_per_sqft(listings(spark, sf))).select("id", "reason")
