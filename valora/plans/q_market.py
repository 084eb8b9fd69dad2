"""Market metric queries (A1, A5-A7, A14, A15, K1, U2, P7 ...)."""

from __future__ import annotations

from pyspark.sql import functions as F

from valora import params as P
from valora.functions import stats as ST
from valora.operators import enrich as EN
from valora.operators import market as M
from valora.operators import valuation as VA
from valora.plans.catalog import register, with_views
from valora.sources.tables import demand_feed, listings, table, zip_dim

L = with_views("listings")


@register("market_pulse", L + """
SELECT ROUND(AVG(days_on_market), 1) AS avg_dom, MIN(days_on_market) AS min_dom,
       MAX(days_on_market) AS max_dom, COUNT(*) AS total_listings,
       ROUND(SUM(price), 2) AS total_volume, ROUND(AVG(price), 0) AS avg_price
FROM listings""")
def q_market_pulse(spark, sf):
    return M.market_pulse_sql(spark, listings(spark, sf))


@register("top_zips", L + """
SELECT zip_code, ROUND(AVG(price / sqft), 0) AS price_per_sqft, COUNT(*) AS count
FROM listings GROUP BY zip_code ORDER BY price_per_sqft DESC, zip_code LIMIT 5""")
def q_top_zips(spark, sf):
    return M.top_zips(listings(spark, sf))


# ---------------------------------------------------------------- A1, A5, A14, A15, U2, P7



def r6(c):
    return F.round(c, 6)


@register("zip_median", L + """
SELECT zip_code, median(sqft) AS zip_median_sqft, (SELECT median(sqft) FROM listings) AS overall_median_sqft
FROM listings GROUP BY zip_code""")
def q_zip_median(spark, sf):
    return M.zip_median(listings(spark, sf))


@register("zip_summary", L + """
SELECT zip_code, COUNT(*) AS count, ROUND(SUM(price), 2) / COUNT(price) AS avg_price,
  median(price) AS median_price, ROUND(SUM(sqft), 2) / COUNT(sqft) AS avg_sqft,
  ROUND(AVG(price / sqft), 6) AS avg_price_per_sqft
FROM listings GROUP BY zip_code""")
def q_zip_summary(spark, sf):
    out = M.zip_summary(listings(spark, sf))
    return out.withColumn("avg_price_per_sqft", r6(F.col("avg_price_per_sqft")))


@register("price_histogram", L + """
, b AS (SELECT MIN(price) AS lo, MAX(price) AS hi FROM listings),
h AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((price - lo) / ((hi - lo) / 30)), 29) END AS BIGINT) AS bin,
  lo, hi FROM listings, b WHERE price IS NOT NULL)
SELECT bin, ROUND(MIN(lo) + bin * (MIN(hi) - MIN(lo)) / 30, 2) AS bin_start,
  ROUND(MIN(lo) + (bin + 1) * (MIN(hi) - MIN(lo)) / 30, 2) AS bin_end, COUNT(*) AS count
FROM h GROUP BY bin""".replace("\n, b AS", ", b AS", 1))
def q_price_histogram(spark, sf):
    return M.price_histogram(listings(spark, sf))


@register("screener_bounds", L + """
SELECT CAST(floor(MIN(price)) AS BIGINT) AS min_price, CAST(floor(MAX(price)) AS BIGINT) AS max_price,
  (SELECT string_agg(z, ',' ORDER BY z) FROM (SELECT DISTINCT zip_code AS z FROM listings WHERE zip_code IS NOT NULL) d) AS zip_codes,
  ROUND(SUM(lat), 6) / COUNT(lat) AS center_lat, ROUND(SUM(lon), 6) / COUNT(lon) AS center_lon,
  COUNT(*) FILTER (WHERE price >= 800000 AND price <= 1500000 AND zip_code = '94107') AS match_count
FROM listings""")
def q_screener_bounds(spark, sf):
    out = M.screener_bounds(listings(spark, sf), 800000, 1500000, "94107")
    return out.withColumn("zip_codes", F.array_join("zip_codes", ","))


@register("distinct_zips", L + "SELECT DISTINCT zip_code FROM listings WHERE zip_code IS NOT NULL")
def q_distinct_zips(spark, sf):
    return M.distinct_zips(listings(spark, sf))


VAL = L.rstrip("\n") + """
, val AS (SELECT *, median(price) OVER (PARTITION BY zip_code) AS model_price FROM listings),
vs AS (SELECT *, model_price - price AS price_delta, (model_price - price) / price * 100 AS price_delta_pct,
  CASE WHEN model_price - price > 0 THEN 'Undervalued' ELSE 'Overvalued' END AS valuation_status FROM val)
""".replace("\n, val AS", ", val AS", 1)


def zip_avm(ls):
    """Zip-median market valuation: the benchmark model price per listing
    (median of the zip, one aggregate row per zip joined back)."""
    med = ST.quantiles(ls.where(F.col("zip_code").isNotNull()), ["zip_code"], {"model_price": ("price", 0.5)})
    return ls.join(med, "zip_code", "left")


@register("valuation_status", VAL + """
SELECT id, ROUND(model_price, 6) AS model_price, ROUND(price_delta, 6) AS price_delta,
  ROUND(price_delta_pct, 6) AS price_delta_pct, valuation_status FROM vs""")
def q_valuation_status(spark, sf):
    out = VA.valuation_status(zip_avm(listings(spark, sf)))
    return out.select("id", r6(F.col("model_price")).alias("model_price"),
                      r6(F.col("price_delta")).alias("price_delta"),
                      r6(F.col("price_delta_pct")).alias("price_delta_pct"), "valuation_status")


@register("screener", VAL + """
SELECT id, price, zip_code, valuation_status FROM vs
WHERE price BETWEEN 800000 AND 1500000 AND zip_code = '94107' AND valuation_status = 'Undervalued'""")
def q_screener(spark, sf):
    v = VA.valuation_status(zip_avm(listings(spark, sf)))
    return M.screener(v, 800000, 1500000, "94107", "Undervalued").select(
        "id", "price", "zip_code", "valuation_status")


@register("map_projection", VAL + """
SELECT id, lat, lon, CASE WHEN price_delta > 0 THEN '#00D47E' ELSE '#FF4757' END AS color FROM vs""")
def q_map_projection(spark, sf):
    v = VA.valuation_status(zip_avm(listings(spark, sf)))
    return VA.map_projection(v).select("id", "lat", "lon", "color")


@register("currency_short", VAL + """
SELECT id, CASE WHEN price_delta < 0 THEN '-' || s WHEN price_delta <> 0 THEN '+' || s ELSE s END AS delta_label
FROM (SELECT id, price_delta, CASE WHEN abs(price_delta) >= 1000000 THEN '$' || printf('%.1f', abs(price_delta) / 1000000) || 'M'
  WHEN abs(price_delta) >= 1000 THEN '$' || printf('%.0f', abs(price_delta) / 1000) || 'k'
  ELSE '$' || printf('%.0f', abs(price_delta)) END AS s FROM vs) x""")
def q_currency_short(spark, sf):
    v = VA.valuation_status(zip_avm(listings(spark, sf)))
    return v.select("id", VA.currency_short("price_delta").alias("delta_label"))


# ---------------------------------------------------------------- P8, P9

@register("condition_label", L + """
SELECT id, CASE condition WHEN 1 THEN 'Poor' WHEN 2 THEN 'Fair' WHEN 3 THEN 'Average'
  WHEN 4 THEN 'Good' WHEN 5 THEN 'Excellent' ELSE 'N/A' END AS condition_label FROM listings""")
def q_condition_label(spark, sf):
    return listings(spark, sf).select("id", VA.condition_label().alias("condition_label"))


@register("property_label", L + """
SELECT id, 'ID ' || CAST(id AS VARCHAR) || ': $' || format('{:,.0f}', price) || ' | '
  || coalesce(CAST(sqft AS VARCHAR), 'nan') || ' sqft | ' || coalesce(zip_code, 'None') AS label FROM listings""")
def q_property_label(spark, sf):
    return listings(spark, sf).select("id", VA.property_label().alias("label"))


# ---------------------------------------------------------------- P13-P15

def _products():
    r = P.CURRENT_RATES
    return [("30_year_fixed", r["30_year_fixed"], 30), ("15_year_fixed", r["15_year_fixed"], 15),
            ("5_1_arm", r["5_1_arm"], 30)]


def _products_sql():
    return "(VALUES " + ", ".join(f"('{p}', CAST({rate} AS DOUBLE), {t})" for p, rate, t in _products()) \
        + ") AS pr(product, rate, term)"


def _explode_products(df):
    arr = F.array(*[F.struct(F.lit(p).alias("product"), F.lit(float(rate)).alias("rate"),
                             F.lit(t).alias("term")) for p, rate, t in _products()])
    return df.withColumn("_p", F.explode(arr)).select("*", "_p.*").drop("_p")


def _impact_sql():
    return "(VALUES " + ", ".join(
        "('" + "', '".join(x.replace("'", "''") for x in row) + "')" for row in P.RATE_IMPACT) + \
        ") AS ri(environment, sentiment, buyer_impact, seller_impact, investment_note)"


@register("rate_environment", L + f"""
SELECT l.id, pr.product, pr.rate, e.environment, ri.sentiment, ri.buyer_impact, ri.investment_note,
  ROUND(pr.rate - {P.RATE_HISTORY['one_year_ago']}, 6) AS yoy_change,
  CASE WHEN pr.rate - {P.RATE_HISTORY['one_year_ago']} > 0 THEN 'up' ELSE 'down' END AS yoy_direction,
  ROUND(pr.rate - {P.RATE_HISTORY['ten_year_avg']}, 6) AS vs_10yr_avg,
  CASE WHEN pr.rate - {P.RATE_HISTORY['ten_year_avg']} > 0 THEN 'above' ELSE 'below' END AS vs_10yr_direction
FROM listings l, {_products_sql()},
  LATERAL (SELECT CASE WHEN pr.rate >= 7.0 THEN 'high' WHEN pr.rate >= 6.0 THEN 'elevated'
    WHEN pr.rate >= 5.0 THEN 'moderate' ELSE 'favorable' END AS environment) e
  JOIN {_impact_sql()} ON ri.environment = e.environment""")
def q_rate_environment(spark, sf):
    df = _explode_products(listings(spark, sf).select("id"))
    out = VA.add_rate_context(df, spark, "rate")
    return out.select("id", "product", "rate", "environment", "sentiment", "buyer_impact",
                      "investment_note", r6(F.col("yoy_change")).alias("yoy_change"), "yoy_direction",
                      r6(F.col("vs_10yr_avg")).alias("vs_10yr_avg"), "vs_10yr_direction")


@register("monthly_payment", L + f"""
SELECT id, product, loan AS loan_amount, ROUND(pi, 4) AS monthly_pi,
  tax AS monthly_tax, ins AS monthly_insurance, ROUND(pi + tax + ins, 4) AS total_monthly
FROM (SELECT l.id, pr.product, l.price * (1 - CAST(0.2 AS DOUBLE)) AS loan,
  CASE WHEN pr.rate / 100 / 12 > 0 THEN l.price * (1 - CAST(0.2 AS DOUBLE)) * (pr.rate / 100 / 12 * pow(1.0 + pr.rate / 100 / 12, CAST(pr.term * 12 AS DOUBLE)))
    / (pow(1.0 + pr.rate / 100 / 12, CAST(pr.term * 12 AS DOUBLE)) - 1) ELSE l.price * (1 - CAST(0.2 AS DOUBLE)) / (pr.term * 12) END AS pi,
  l.price * CAST(0.0115 AS DOUBLE) / 12 AS tax, l.price * CAST(0.003 AS DOUBLE) / 12 AS ins
  FROM listings l, {_products_sql()}) x""")
def q_monthly_payment(spark, sf):
    # one scan: the three products are a literal array; each row takes its own
    # product's columns
    products = _products()
    arr = F.array(*[F.struct(F.lit(p).alias("product")) for p, _, _ in products])
    rows = listings(spark, sf).select("id", "price", F.explode(arr).alias("x")).select("id", "price", "x.product")
    cols = ["loan_amount", "monthly_pi", "monthly_tax", "monthly_insurance", "total_monthly"]
    out = rows
    for i, (_, rate, t) in enumerate(products):
        out = VA.monthly_payment(out, rate=rate, term_years=t).withColumnsRenamed({c: f"_{c}_{i}" for c in cols})
    pick = lambda c: F.coalesce(*[F.when(F.col("product") == p, F.col(f"_{c}_{i}")) for i, (p, _, _) in enumerate(products)])
    out = out.select("id", "product", *[pick(c).alias(c) for c in cols])
    # loan/tax/insurance are exact IEEE products on both engines; only the
    # pow-based columns are rounded
    return out.select("id", "product", "loan_amount", F.round("monthly_pi", 4).alias("monthly_pi"),
                      "monthly_tax", "monthly_insurance",
                      F.round("total_monthly", 4).alias("total_monthly"))


def _afford_sql():
    rate = P.CURRENT_RATES["30_year_fixed"]
    one, ten = P.RATE_HISTORY["one_year_ago"], P.RATE_HISTORY["ten_year_avg"]
    env = ("CASE WHEN r >= 7.0 THEN 'high' WHEN r >= 6.0 THEN 'elevated' "
           "WHEN r >= 5.0 THEN 'moderate' ELSE 'favorable' END")
    return L + f"""
SELECT id, '**Interest Rate Environment: ' || upper(ri.sentiment) || '**' || chr(10)
  || 'Current 30-Year Fixed: {rate:.2f}% (as of {P.CURRENT_RATES['last_updated']})' || chr(10)
  || '- Year-over-Year: ' || printf('%+.2f%%', r - {one}) || ' (' || CASE WHEN r - {one} > 0 THEN 'up' ELSE 'down' END || ')' || chr(10)
  || '- vs 10-Year Average: ' || printf('%+.2f%%', r - {ten}) || ' (' || CASE WHEN r - {ten} > 0 THEN 'above' ELSE 'below' END || ')'
  || chr(10) || chr(10) || '**Monthly Payment Estimate** (20% down):' || chr(10) || '- Principal & Interest: $' || format('{{:,.0f}}', pi)
  || chr(10) || '- Est. Taxes: $' || format('{{:,.0f}}', tax)
  || chr(10) || '- Est. Insurance: $' || format('{{:,.0f}}', ins)
  || chr(10) || '- **Total PITI: $' || format('{{:,.0f}}', pi + tax + ins)
  || '/month**' || chr(10) || chr(10) || '**Rate Impact Assessment:**' || chr(10) || '- Buyer Impact: ' || ri.buyer_impact
  || chr(10) || '- Investment Note: ' || ri.investment_note AS affordability_text
FROM (SELECT id, CAST({rate} AS DOUBLE) AS r,
  price * (1 - CAST(0.2 AS DOUBLE)) * (CAST({rate} AS DOUBLE) / 100 / 12 * pow(1.0 + CAST({rate} AS DOUBLE) / 100 / 12, CAST(360 AS DOUBLE)))
    / (pow(1.0 + CAST({rate} AS DOUBLE) / 100 / 12, CAST(360 AS DOUBLE)) - 1) AS pi,
  price * CAST(0.0115 AS DOUBLE) / 12 AS tax, price * CAST(0.003 AS DOUBLE) / 12 AS ins FROM listings) x
JOIN {_impact_sql()} ON ri.environment = {env.replace('r >=', 'x.r >=')}"""


@register("affordability_text", _afford_sql())
def q_affordability_text(spark, sf):
    out = VA.affordability_text(listings(spark, sf).select("id", "price"), spark)
    return out.select("id", "affordability_text")


# ---------------------------------------------------------------- J1, J8-J10, S10

ZD = with_views("listings", "zip_dim")


@register("zip_enrich", ZD + """
SELECT l.id, l.zip_code, z.city, z.county, z.state, z.population, z.population_density,
  z.median_household_income FROM listings l LEFT JOIN zip_dim z ON l.zip_code = z.zip_code""")
def q_zip_enrich(spark, sf):
    out = EN.zip_enrich(listings(spark, sf).select("id", "zip_code"), zip_dim(spark, sf))
    return out.select("id", "zip_code", "city", "county", "state", "population",
                      "population_density", "median_household_income")


def _news_sql():
    rows = []
    for z, name, sent, news, risks in P.MARKET_NEWS:
        rows.append(f"('{z}', '{name}', '{sent}', '{' | '.join(news)}', '{' | '.join(risks)}')")
    return "(VALUES " + ", ".join(rows) + ") AS mn(zip_code, neighborhood, sentiment, news, risk_factors)"


@register("market_context_static", L + f"""
SELECT l.id, coalesce(mn.neighborhood, '{P.DEFAULT_MARKET_NEWS[0]}') AS neighborhood,
  coalesce(mn.sentiment, '{P.DEFAULT_MARKET_NEWS[1]}') AS sentiment,
  coalesce(mn.news, '{' | '.join(P.DEFAULT_MARKET_NEWS[2])}') AS news,
  coalesce(mn.risk_factors, '{' | '.join(P.DEFAULT_MARKET_NEWS[3])}') AS risk_factors
FROM listings l LEFT JOIN {_news_sql()} ON l.zip_code = mn.zip_code""")
def q_market_context_static(spark, sf):
    out = EN.market_context_static(listings(spark, sf).select("id", "zip_code"), spark)
    return out.select("id", "neighborhood", "sentiment", F.array_join("news", " | ").alias("news"),
                      F.array_join("risk_factors", " | ").alias("risk_factors"))


@register("neighborhood_name", L + f"""
SELECT l.id, coalesce(mn.neighborhood, '{P.DEFAULT_NEIGHBORHOOD}') AS neighborhood
FROM listings l LEFT JOIN {_news_sql()} ON l.zip_code = mn.zip_code""")
def q_neighborhood_name(spark, sf):
    return listings(spark, sf).select("id", EN.neighborhood_name().alias("neighborhood"))


@register("zip_market_stats", ZD + """
SELECT z.zip_code, s.median_sale_price, ROUND(s.median_ppsf, 6) AS median_ppsf, s.homes_sold
FROM zip_dim z LEFT JOIN (SELECT zip_code, median(price) AS median_sale_price,
  median(price / NULLIF(sqft, 0)) AS median_ppsf, COUNT(*) AS homes_sold
  FROM listings WHERE zip_code IS NOT NULL GROUP BY zip_code) s ON z.zip_code = s.zip_code""")
def q_zip_market_stats(spark, sf):
    stats = EN.zip_market_stats(listings(spark, sf))
    out = zip_dim(spark, sf).select("zip_code").join(stats, "zip_code", "left")
    return out.select("zip_code", "median_sale_price", r6(F.col("median_ppsf")).alias("median_ppsf"),
                      "homes_sold")


@register("region_to_zip", L + """
SELECT REGION, CASE WHEN regexp_extract(REGION, '(\\d{5})', 1) = '' THEN NULL
  ELSE regexp_extract(REGION, '(\\d{5})', 1) END AS zip_code
FROM (SELECT 'Zip Code: ' || zip_code AS REGION FROM listings
      UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT c_name FROM customer) r""")
def q_region_to_zip(spark, sf):
    cust = table(spark, sf, "customer")
    regions = (listings(spark, sf).select(F.concat(F.lit("Zip Code: "), F.col("zip_code")).alias("REGION"))
               .unionByName(cust.select(F.col("c_mktsegment").alias("REGION")))
               .unionByName(cust.select(F.col("c_name").alias("REGION"))))
    return regions.select("REGION", EN.region_to_zip("REGION").alias("zip_code"))


# ---------------------------------------------------------------- U1, W4, W5

DF = with_views("demand_feed")


@register("union_sources", DF + """
SELECT id, address, source, price, NULL::DOUBLE AS price_b FROM demand_feed WHERE source = 'feed_a'
UNION ALL SELECT id, address, source, NULL::DOUBLE, price FROM demand_feed WHERE source = 'feed_b'""")
def q_union_sources(spark, sf):
    d = demand_feed(spark, sf)
    a = d.where("source = 'feed_a'").select("id", "address", "source", "price")
    b = d.where("source = 'feed_b'").select("id", "address", "source", F.col("price").alias("price_b"))
    return EN.union_sources(a, b).select("id", "address", "source", "price", "price_b")


DEDUP = DF.rstrip("\n") + """
, dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY source, id) AS rn
  FROM demand_feed WHERE address IS NOT NULL) x WHERE rn = 1
  UNION ALL SELECT *, 1 FROM demand_feed WHERE address IS NULL)
""".replace("\n, dd AS", ", dd AS", 1)


@register("dedupe_keep_first", DEDUP + "SELECT id, address, source, price FROM dd")
def q_dedupe(spark, sf):
    return EN.dedupe_keep_first(demand_feed(spark, sf)).select("id", "address", "source", "price")


@register("renumber_ids", DEDUP + """
SELECT CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS new_id, id AS orig_id FROM dd""")
def q_renumber(spark, sf):
    d = EN.dedupe_keep_first(demand_feed(spark, sf)).withColumnRenamed("id", "orig_id")
    return EN.renumber_ids(d, "orig_id", "new_id").select("new_id", "orig_id")


# ---------------------------------------------------------------- A10-A12 (zip AVM)

def _metrics_df(spark, sf):
    return zip_avm(listings(spark, sf)).withColumnRenamed("model_price", "prediction")


@register("ppe", VAL + """
SELECT ROUND(AVG(CASE WHEN abs((price - model_price) / price) <= 0.10 THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS ppe10,
  ROUND(AVG(CASE WHEN abs((price - model_price) / price) <= 0.20 THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS ppe20
FROM val WHERE price <> 0""")
def q_ppe(spark, sf):
    from valora.operators import metrics as MT
    out = MT.ppe(_metrics_df(spark, sf), "price", "prediction")
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


@register("mdape", VAL + """
SELECT ROUND(median(abs((price - model_price) / price) * 100), 6) AS mdape FROM val WHERE price <> 0""")
def q_mdape(spark, sf):
    from valora.operators import metrics as MT
    return MT.mdape(_metrics_df(spark, sf), "price", "prediction").select(r6(F.col("mdape")).alias("mdape"))


@register("regression_metrics", VAL + """
SELECT ROUND(sqrt(AVG(pow(price - model_price, 2))), 4) AS rmse, ROUND(AVG(abs(price - model_price)), 4) AS mae,
  ROUND(1 - SUM(pow(price - model_price, 2)) / (SUM(pow(price - (SELECT AVG(price) FROM listings), 2))), 8) AS r2
FROM val""")
def q_regression_metrics(spark, sf):
    from valora.operators import metrics as MT
    out = MT.regression_metrics(_metrics_df(spark, sf), "price", "prediction")
    return out.select(F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"),
                      F.round("r2", 8).alias("r2"))


@register("topk_groups", L + """
SELECT zip_code, ROUND(AVG(price / sqft), 0) AS price_per_sqft, COUNT(*) AS count
FROM listings GROUP BY zip_code ORDER BY price_per_sqft DESC, zip_code LIMIT 5""")
def q_topk_groups(spark, sf):
    """K1: groups ordered by a metric, top 5 (TakeOrderedAndProject)."""
    return M.top_zips(listings(spark, sf), 5)
