"""Source/sink queries (S1-S11, S13) and end-to-end pipelines."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from valora import params as P
from valora.operators import enrich as EN
from valora.operators import etl as ET
from valora.operators import features as FE
from valora.operators import quality as QU
from valora.operators import spatial as SP
from valora.plans import sqlfrag as Q
from valora.plans.catalog import register, with_views
from valora.session import ensure_checkpoint_dir, stage
from valora.sources import io as IO
from valora.sources.tables import listings, zip_dim

LV = with_views("listings")
LISTING_COLS = ["id", "lat", "lon", "price", "sqft", "bedrooms", "year_built", "zip_code",
                "condition", "days_on_market"]


def _scratch(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), "io", f"{name}-{uuid.uuid4().hex[:8]}")


@register("read_listings_csv", LV + "SELECT * FROM listings")
def q_read_csv(spark, sf):
    path = _scratch(spark, "listings_csv")
    IO.write_csv(listings(spark, sf), path)
    return IO.read_listings_csv(spark, path)


@register("read_listings_parquet", LV + "SELECT * FROM listings")
def q_read_parquet(spark, sf):
    path = _scratch(spark, "listings_parquet")
    IO.write_parquet(listings(spark, sf), path, partition_by=None)
    return IO.read_listings_parquet(spark, path).select(*LISTING_COLS)


@register("source_priority", LV + "SELECT * FROM listings")
def q_source_priority(spark, sf):
    base = _scratch(spark, "sources")
    IO.write_csv(listings(spark, sf), f"{base}/raw.csv")
    return IO.source_priority(spark, [("parquet", f"{base}/preferred.parquet"), ("csv", f"{base}/raw.csv")])


@register("source_priority_preferred", LV + "SELECT * FROM listings")
def q_source_preferred(spark, sf):
    """The preferred file is there, and so is the other; it wins."""
    base = _scratch(spark, "sources")
    ls = listings(spark, sf)
    IO.write_parquet(ls, f"{base}/preferred.parquet")
    IO.write_csv(ls.limit(0), f"{base}/raw.csv")
    return IO.source_priority(spark, [("parquet", f"{base}/preferred.parquet"), ("csv", f"{base}/raw.csv")]).select(*LISTING_COLS)


def _landed_feeds(spark, sf, path):
    """Even ids come from the first provider, odd ones from the second."""
    ls = listings(spark, sf)
    for name, rest, payloads in (("a", 0, _payloads_a), ("b", 1, _payloads_b)):
        IO.land_feed(payloads(ls.where(F.col("id") % 2 == rest)).withColumn("provider", F.lit(name)), path)


FEED_SQL = LV + """
SELECT id, lat, lon, price, sqft, bedrooms, year_built, zip_code, CAST(NULL AS INTEGER) AS condition,
  CASE WHEN id % 2 = 0 THEN days_on_market END AS days_on_market FROM listings"""


@register("source_priority_feed", FEED_SQL)
def q_source_feed(spark, sf):
    """No file is there: the landed feeds are the source."""
    base = _scratch(spark, "sources")
    _landed_feeds(spark, sf, f"{base}/feed")
    return IO.source_priority(spark, [("parquet", f"{base}/preferred.parquet"), ("csv", f"{base}/raw.csv"), ("feed", f"{base}/feed")])


@register("source_priority_forced", FEED_SQL + " WHERE zip_code IN ('94105', '94110')")
def q_source_forced(spark, sf):
    """A file is there, but the feed is forced; the zips prune its folders."""
    base = _scratch(spark, "sources")
    IO.write_csv(listings(spark, sf), f"{base}/raw.csv")
    _landed_feeds(spark, sf, f"{base}/feed")
    out = IO.source_priority(spark, [("csv", f"{base}/raw.csv"), ("feed", f"{base}/feed")], force="feed")
    return out.where(F.col("zip_code").isin("94105", "94110"))


@register("write_parquet", LV + "SELECT * FROM listings")
def q_write_parquet(spark, sf):
    path = _scratch(spark, "partitioned")
    IO.write_parquet(listings(spark, sf), path, partition_by=["zip_code"])
    # explicit schema: zip codes stay strings (no partition type inference)
    return spark.read.schema(IO.LISTING_FILE_SCHEMA).parquet(path)


@register("write_csv", LV + "SELECT " + ", ".join(
    f"CAST({c} AS VARCHAR) AS {c}" for c in LISTING_COLS) + " FROM listings")
def q_write_csv(spark, sf):
    path = _scratch(spark, "csv_out")
    IO.write_csv(listings(spark, sf), path)
    return spark.read.option("header", True).csv(path)


@register("sales_table", LV + """
SELECT zip_code, ROUND(AVG(price / sqft), 0) AS price_per_sqft, COUNT(*) AS count
FROM listings GROUP BY zip_code ORDER BY price_per_sqft DESC, zip_code LIMIT 5""")
def q_sales_table(spark, sf):
    IO.sales_table(listings(spark, sf), "sales", _scratch(spark, "sales"))
    return IO.execute_sql(spark, """SELECT zip_code, ROUND(AVG(price / sqft), 0) AS price_per_sqft,
        COUNT(*) AS count FROM sales GROUP BY zip_code ORDER BY price_per_sqft DESC, zip_code LIMIT 5""")


@register("sales_lookup", LV + """
SELECT id, zip_code, price, 'zip' AS via FROM listings WHERE zip_code = '94107' AND price > 1000000
UNION ALL SELECT id, zip_code, price, 'id' FROM listings WHERE id % 1000 = 7 AND id < 20000""")
def q_sales_lookup(spark, sf):
    """The two lookups the table is made for: one bucket for a zip, bloom
    filters for ids."""
    sales = IO.sales_table(listings(spark, sf), "sales_lookup", _scratch(spark, "sales"))
    by_zip = sales.where("zip_code = '94107' AND price > 1000000").select("id", "zip_code", "price", F.lit("zip").alias("via"))
    wanted = [i for i in range(7, 20_000, 1000)]
    by_id = sales.where(F.col("id").isin(wanted)).select("id", "zip_code", "price", F.lit("id").alias("via"))
    return by_zip.unionByName(by_id)


def _batches(df):
    """Bounded landing batches: one payload per (zip, id div 50)."""
    return df.withColumn("_batch", F.floor(F.col("id") / 50))


def _payloads_a(ls):
    prop = F.struct(F.col("id").alias("zpid"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
                    "price", F.col("sqft").alias("livingArea"), "bedrooms",
                    F.col("year_built").alias("yearBuilt"),
                    F.struct(F.col("zip_code").alias("zipcode"),
                             F.concat(F.lit("ADDR-"), F.col("id").cast("string")).alias("streetAddress")).alias("address"),
                    F.lit("SINGLE_FAMILY").alias("propertyType"), F.col("days_on_market").alias("daysOnZillow"))
    return _batches(ls).groupBy("zip_code", "_batch").agg(F.to_json(F.struct(F.collect_list(prop).alias("props"))).alias("payload"))


def _payloads_b(ls):
    prop = F.struct(F.col("id").alias("propertyId"),
                    F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("latLong"),
                    F.struct(F.col("price").alias("amount")).alias("priceInfo"),
                    F.struct(F.col("sqft").alias("amount")).alias("sqftInfo"),
                    F.col("bedrooms").alias("beds"), F.col("year_built").alias("yearBuilt"),
                    F.col("zip_code").alias("postalCode"))
    return _batches(ls).groupBy("zip_code", "_batch").agg(
        F.to_json(F.struct(F.struct(F.collect_list(prop).alias("results")).alias("data"))).alias("payload"))


@register("parse_listing_payload_a", LV + """
SELECT id, lat, lon, price, sqft, bedrooms, CAST(NULL AS DOUBLE) AS bathrooms, year_built, zip_code,
  'ADDR-' || CAST(id AS VARCHAR) AS address, 'SINGLE_FAMILY' AS property_type, days_on_market FROM listings""")
def q_payload_a(spark, sf):
    return IO.parse_payload_a(_payloads_a(listings(spark, sf)))


@register("parse_listing_payload_b", LV + """
SELECT id, lat, lon, price, sqft, bedrooms, year_built, zip_code FROM listings""")
def q_payload_b(spark, sf):
    return IO.parse_payload_b(_payloads_b(listings(spark, sf)))


@register("read_market_stats", LV + """
SELECT zip_code, median(price) AS MEDIAN_SALE_PRICE, ROUND(median(price / NULLIF(sqft, 0)), 6) AS MEDIAN_PPSF,
  COUNT(*) AS HOMES_SOLD FROM listings WHERE zip_code IS NOT NULL GROUP BY zip_code""")
def q_market_stats(spark, sf):
    path = _scratch(spark, "market_stats")
    st = EN.zip_market_stats(listings(spark, sf)).select(
        "zip_code", F.col("median_sale_price").alias("MEDIAN_SALE_PRICE"),
        F.round("median_ppsf", 6).alias("MEDIAN_PPSF"), F.col("homes_sold").alias("HOMES_SOLD"))
    IO.write_csv(st, path)
    return IO.read_market_stats(spark, path)


_STATUS = [1, 1, 1, 1, 2, 30, 31, 40, 41, 42, 99]


def _walk_sql():
    """Landed scores: the fixture gives each listing a score and a status."""
    st = "CASE " + " ".join(f"WHEN id % 11 = {i} THEN {s}" for i, s in enumerate(_STATUS)) + " END"
    msgs = " ".join(f"WHEN {k} THEN '{v}'" for k, v in P.WALKSCORE_STATUS.items())
    return f"""SELECT id,
  CASE WHEN st = 1 THEN ws END AS walk_score,
  CASE WHEN st = 1 AND id % 5 <> 0 THEN ws - 5 END AS transit_score,
  CASE WHEN st = 1 THEN ws + 5 END AS bike_score,
  'ws/' || CAST(id AS VARCHAR) AS ws_link,
  CASE WHEN st = 1 THEN (CASE WHEN ws >= 90 THEN 'Walker''s Paradise' ELSE 'Very Walkable' END) END AS description,
  CASE WHEN st <> 1 THEN coalesce(CASE st {msgs} END, 'Unknown status ' || CAST(st AS VARCHAR)) END AS error
FROM (SELECT id, {st} AS st, CAST(10 + (id * 37) % 86 AS INTEGER) AS ws FROM listings) x"""


def landed_walk_scores(spark, sf):
    """Walk-score responses as they land, parsed: one row per listing."""
    st = F.element_at(F.array(*[F.lit(s) for s in _STATUS]), (F.col("id") % 11 + 1).cast("int"))
    w = (10 + (F.col("id") * 37) % 86).cast("int")
    payload = F.to_json(F.struct(
        st.alias("status"), w.alias("walkscore"),
        F.when(w >= 90, F.lit("Walker's Paradise")).otherwise(F.lit("Very Walkable")).alias("description"),
        F.concat(F.lit("ws/"), F.col("id").cast("string")).alias("ws_link"),
        F.when(F.col("id") % 5 != 0, F.to_json(F.struct((w - 5).alias("score"), F.lit("Good Transit").alias("description"))))
        .otherwise(F.lit("n/a")).alias("transit"),
        F.to_json(F.struct((w + 5).alias("score"), F.lit("Bikeable").alias("description"))).alias("bike")))
    return IO.parse_walkscore(listings(spark, sf).select("id", payload.alias("payload")))


@register("parse_walkscore_payload", LV + _walk_sql())
def q_walkscore(spark, sf):
    return landed_walk_scores(spark, sf).select(
        "id", "walk_score", "transit_score", "bike_score", "ws_link", "description", "error")


def _chunk_store_sql():
    from valora.plans.q_text import _ingest_sql
    return _ingest_sql()


@register("chunk_store_seed_clear", _chunk_store_sql())
def q_chunk_store(spark, sf):
    """Seed, clear, then seed twice (the second seed adds nothing: left-anti on
    id); the metadata map is reported as its JSON text."""
    from valora.operators.text import ingest_text
    from valora.sources.tables import table
    path = _scratch(spark, "chunk_store")
    d = table(spark, sf, "documents").withColumn(
        "source_name", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    seed = stage(ingest_text(d, source_col="source_name", extra_meta=["lang"]), "chunk_seed")
    IO.seed_chunk_store(path, seed)
    if IO.clear_chunk_store(path, seed.schema).count():
        raise RuntimeError("the cleared chunk store still has rows")
    IO.seed_chunk_store(path, seed)
    out = IO.seed_chunk_store(path, seed)
    return out.withColumn("metadata", F.to_json("metadata"))


# ------------------------------------------------------------------ pipelines

def run_etl(spark, sf, validate: bool = True):
    """E1 from landed files: the first source that is there goes through
    ``operators.etl.run_etl``."""
    base = _scratch(spark, "etl")
    IO.write_csv(listings(spark, sf), f"{base}/raw.csv")
    raw = IO.source_priority(spark, [("parquet", f"{base}/preferred.parquet"), ("csv", f"{base}/raw.csv")])
    return ET.run_etl(raw, base, validate).sales


def _etl_sql(extra: str = ""):
    from valora.plans import q_spatial as QS
    imp = """sqm AS (SELECT zip_code, median(sqft) AS m FROM listings WHERE zip_code IS NOT NULL GROUP BY zip_code),
som AS (SELECT median(sqft) AS m FROM listings),
li AS (SELECT l.id, l.lat, l.lon, l.price, coalesce(l.sqft, sqm.m, som.m) AS sqft, l.sqft IS NULL AS sqft_imputed,
  l.bedrooms, l.year_built, l.zip_code,
  CAST(coalesce(l.condition, CASE WHEN 2025 - l.year_built < 10 THEN 5 WHEN 2025 - l.year_built < 25 THEN 4
    WHEN 2025 - l.year_built < 50 THEN 3 WHEN 2025 - l.year_built < 75 THEN 2 ELSE 1 END) AS INTEGER) AS condition
  FROM listings l LEFT JOIN sqm ON l.zip_code = sqm.zip_code, som)"""
    lc = f"lc AS {Q.with_cell_id('li')}"
    ctes = ",\n".join([imp, QS.TIERS, lc, QS.LCP.strip(), QS.CELLS, QS.NB, QS.PCT, QS.LAGS])
    return LV.rstrip("\n") + ",\n" + ctes + f"""
SELECT li.id, li.sqft, li.sqft_imputed, li.condition, 2025 - li.year_built AS property_age,
  ROUND({Q.dist_center('li.lat', 'li.lon')}, 6) AS distance_to_downtown_km,
  CAST(coalesce(t.neighborhood_price_tier, 3) AS INTEGER) AS neighborhood_price_tier,
  ROUND(coalesce(g.h3_median_ppsf, median(g.h3_median_ppsf) OVER ()), 6) AS h3_median_ppsf,
  ROUND(coalesce(g.h3_neighbor_median_ppsf, median(g.h3_neighbor_median_ppsf) OVER ()), 6) AS h3_neighbor_median_ppsf,
  ROUND(coalesce(g.h3_listing_density, median(g.h3_listing_density) OVER ()), 6) AS h3_listing_density,
  ROUND(coalesce(g.h3_price_percentile, median(g.h3_price_percentile) OVER ()), 6) AS h3_price_percentile{extra}
FROM li LEFT JOIN tiers t ON li.zip_code = t.zip_code JOIN lags g ON li.id = g.id"""


@register("run_etl", _etl_sql())
def q_run_etl(spark, sf):
    """E1 end to end; the processed table projected to its imputation,
    V2.2 and V3 columns."""
    out = run_etl(spark, sf)
    r6 = lambda c: F.round(F.col(c), 6).alias(c)
    return out.select("id", "sqft", "sqft_imputed", "condition", "property_age",
                      r6("distance_to_downtown_km"), "neighborhood_price_tier",
                      *[r6(c) for c in SP.LAG_COLS])


@register("ingest_all", with_views("listings", "zip_dim") + """
, u AS (SELECT zip_code, id AS source_id, lat, lon, price, sqft, bedrooms, CAST(NULL AS DOUBLE) AS bathrooms,
    year_built, CASE WHEN id % 5 <> 0 THEN 'ADDR-' || CAST(id // 3 AS VARCHAR) END AS address,
    'SINGLE_FAMILY' AS property_type, days_on_market, 'feed_a' AS source FROM listings WHERE id % 2 = 0
  UNION ALL
  SELECT zip_code, id, lat, lon, price, sqft, bedrooms, NULL, year_built,
    CASE WHEN id % 5 <> 0 THEN 'ADDR-' || CAST(id // 3 AS VARCHAR) END, NULL, NULL, 'feed_b' FROM listings WHERE id % 2 = 1)
SELECT u.*, z.city, z.county, z.state, z.population, z.population_density, z.median_household_income,
  CAST(row_number() OVER (ORDER BY CASE WHEN u.source = 'feed_a' THEN 0 ELSE 1 END, u.source_id) AS BIGINT) AS id
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY source, source_id) AS rn FROM u)
  WHERE rn = 1 OR address IS NULL) u LEFT JOIN zip_dim z ON u.zip_code = z.zip_code""".replace("\n, u AS", ", u AS", 1)
          .replace("SELECT u.*,", "SELECT u.* EXCLUDE (rn),"))
def q_ingest_all(spark, sf):
    """Per-zip landed payloads of two feeds -> parse -> tag -> union ->
    dedupe by address (within and across the feeds) -> zip enrich -> ids 1..n."""
    street = F.when(F.col("id") % 5 != 0, F.concat(F.lit("ADDR-"), F.floor(F.col("id") / 3).cast("string")))
    a = q_payload_a(spark, sf).where(F.col("id") % 2 == 0).withColumns({"address": street, "source": F.lit("feed_a")})
    b = q_payload_b(spark, sf).where(F.col("id") % 2 == 1).withColumns({"address": street, "source": F.lit("feed_b")})
    u = EN.union_sources(a, b).withColumnRenamed("id", "source_id")
    d = EN.dedupe_keep_first(u, "address", order=("source", "source_id"))
    e = EN.zip_enrich(d, zip_dim(spark, sf))
    return EN.renumber_ids(e.withColumn("_ord", F.when(F.col("source") == "feed_a", 0).otherwise(1)
                                        * F.lit(1 << 40) + F.col("source_id")), "_ord", "id").drop("_ord")


WALK_COLS = ["walk_score", "transit_score", "bike_score"]
V2_COLS = ["property_age", "distance_to_downtown_km", "distance_to_nearest_bart_km", "neighborhood_price_tier"]


def ensure_features(df, landed=None):
    """A feature group is added where one of its columns is missing or
    all NULL (one aggregate over the columns that are there decides for all
    three groups).  ``landed``: parsed walk-score responses by id."""
    there = [c for c in [*V2_COLS, *SP.LAG_COLS, *WALK_COLS] if c in df.columns]
    filled = df.agg(*[F.count(c).alias(c) for c in there]).first().asDict() if there else {}

    def lacks(group):
        return any(not filled.get(c) for c in group)
    for group, add in ((V2_COLS, FE.add_v2_features), (SP.LAG_COLS, SP.spatial_lags),
                       (WALK_COLS, lambda d: d.join(landed.select("id", *WALK_COLS), "id", "left"))):
        if lacks(group) and (group is not WALK_COLS or landed is not None):
            df = add(df.drop(*group))
    return df


def _ensure_sql():
    full = _etl_sql(", wl.walk_score, wl.transit_score, wl.bike_score")
    head, tail = full.rsplit("FROM li", 1)
    ctes, select = head.rsplit("\nSELECT ", 1)
    return f"{ctes},\nwl AS ({_walk_sql()})\nSELECT {select}FROM li{tail} LEFT JOIN wl ON li.id = wl.id"


@register("ensure_features", _ensure_sql())
def q_ensure_features(spark, sf):
    out = ensure_features(QU.impute_condition(QU.impute_sqft(listings(spark, sf))), landed_walk_scores(spark, sf))
    r6 = lambda c: F.round(F.col(c), 6).alias(c)
    return out.select("id", "sqft", "sqft_imputed", "condition", "property_age",
                      r6("distance_to_downtown_km"), "neighborhood_price_tier",
                      *[r6(c) for c in SP.LAG_COLS], *WALK_COLS)


RANGED = {"property_age": "2025 - year_built", "distance_to_downtown_km": Q.dist_center("l.lat", "l.lon"),
          "distance_to_nearest_bart_km": Q.dist_station("l.lat", "l.lon")}


@register("feature_ranges", LV.rstrip("\n") + f""",
wl AS ({_walk_sql()}),
f AS (SELECT {", ".join(f"CAST({x} AS DOUBLE) AS {c}" for c, x in RANGED.items())}, walk_score, transit_score, bike_score
  FROM listings l LEFT JOIN wl ON l.id = wl.id)
""" + "\nUNION ALL\n".join(f"""SELECT '{c}' AS feature, COUNT({c}) AS n, ROUND(CAST(MIN({c}) AS DOUBLE), 6) AS min,
  ROUND(CAST(MAX({c}) AS DOUBLE), 6) AS max, ROUND(CAST(median({c}) AS DOUBLE), 6) AS median,
  ROUND(AVG(CAST({c} AS DOUBLE)), 6) AS mean FROM f""" for c in [*RANGED, *WALK_COLS]))
def q_feature_ranges(spark, sf):
    """One row per feature, on landed scores."""
    f = FE.add_v2_features(listings(spark, sf)).join(landed_walk_scores(spark, sf).select("id", *WALK_COLS), "id", "left")
    return FE.feature_ranges(f, [*RANGED, *WALK_COLS])
