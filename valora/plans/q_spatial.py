"""Spatial, feature and spatial-lag queries (G1-G12, A2-A4, A20, J2-J5, W1-W2,
P2, P3, P12, E2, E3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from valora.functions import geo
from valora.operators import features as FE
from valora.operators import spatial as SP
from valora.plans import sqlfrag as Q
from valora.plans.catalog import register, with_views
from valora.session import stage
from valora.sources.tables import listings

LV = with_views("listings")


def r6(c):
    return F.round(c, 6)


LC = f"lc AS {Q.with_cell_id('listings')}\n"
LCP = ("lcp AS (SELECT *, price / NULLIF(sqft, 0) AS price_per_sqft FROM lc)\n")


def _lv(*extra: str) -> str:
    return LV.rstrip("\n") + ",\n" + ",\n".join(extra) + "\n"


# ------------------------------------------------------------------ G1-G3

@register("haversine_km", _lv(LC) + f"""
, cent AS (SELECT h3_index, q, r, ROUND(SUM(lat), 5) / COUNT(lat) AS lat, ROUND(SUM(lon), 5) / COUNT(lon) AS lon FROM lc GROUP BY h3_index, q, r)
SELECT a.h3_index, b.h3_index AS nbr_index,
  ROUND({Q.hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 6) AS km
FROM cent a JOIN cent b ON b.q = a.q + 1 AND b.r = a.r""".replace("\n, cent AS", ", cent AS", 1))
def q_haversine(spark, sf):
    """Cell-centroid to east-neighbour-centroid great-circle distances."""
    lc = SP.add_cell_index(listings(spark, sf))
    cent = lc.groupBy("h3_index").agg((F.round(F.sum("lat"), 5) / F.count("lat")).alias("lat"),
                                      (F.round(F.sum("lon"), 5) / F.count("lon")).alias("lon"))
    ax = cent.select("*", geo.cell_unpack("h3_index").alias("_ax"))
    east = ax.select(geo.cell_id(F.col("_ax.q") - 1, F.col("_ax.r")).alias("h3_index"),
                     F.col("h3_index").alias("nbr_index"),
                     F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return (cent.join(east, "h3_index")
            .select("h3_index", "nbr_index",
                    r6(geo.haversine_km("lat", "lon", "lat2", "lon2")).alias("km")))


@register("distance_to_center", LV + f"""
SELECT id, ROUND({Q.dist_center()}, 6) AS distance_to_center_km,
  ROUND({Q.dist_center()}, 6) AS distance_to_downtown_km FROM listings""")
def q_distance_to_center(spark, sf):
    d = r6(geo.distance_to_center())
    return listings(spark, sf).select("id", d.alias("distance_to_center_km"),
                                      d.alias("distance_to_downtown_km"))


@register("distance_to_nearest_station", LV + f"""
SELECT id, ROUND({Q.dist_station()}, 6) AS distance_to_nearest_bart_km FROM listings""")
def q_nearest_station(spark, sf):
    return listings(spark, sf).select(
        "id", r6(geo.distance_to_nearest_station()).alias("distance_to_nearest_bart_km"))


# ------------------------------------------------------------------ G4-G9, G12

@register("cell_index", _lv(LC) + "SELECT id, h3_index FROM lc")
def q_cell_index(spark, sf):
    return listings(spark, sf).select("id", geo.cell_index().alias("h3_index"))


@register("pseudo_cell", LV + """
SELECT id, CAST(floor(lat * 1000 + 0.5) / 1000 AS VARCHAR) || '_' || CAST(floor(lon * 1000 + 0.5) / 1000 AS VARCHAR) AS cell_key
FROM listings""")
def q_pseudo_cell(spark, sf):
    return listings(spark, sf).select("id", geo.pseudo_cell().alias("cell_key"))


@register("cell_numeric", _lv(LC) + f"""
SELECT id, CAST({Q.packed('q', 'r')} AS BIGINT) AS h3_numeric FROM lc""")
def q_cell_numeric(spark, sf):
    return SP.add_cell_numeric(listings(spark, sf)).select("id", "h3_numeric")


@register("cell_center", _lv(LC) + f"""
SELECT h3_index,
  ROUND({geo.sql_literal(37.7749)} + ({geo.sql_literal(geo.EDGE)} * ({geo.sql_literal(1.5)} * r)) / {geo.sql_literal(geo.KY)}, 6) AS center_lat,
  ROUND({geo.sql_literal(-122.4194)} + ({geo.sql_literal(geo.EDGE)} * ({geo.sql_literal(geo.SQRT3)} * q + {geo.sql_literal(geo.SQRT3 / 2.0)} * r)) / {geo.sql_literal(geo.KX)}, 6) AS center_lon
FROM (SELECT DISTINCT h3_index, q, r FROM lc) c""")
def q_cell_center(spark, sf):
    cells = listings(spark, sf).select(geo.cell_index().alias("h3_index")).distinct()
    ax = geo.cell_unpack("h3_index")
    ctr = geo.cell_center(ax["q"], ax["r"])
    return cells.select("h3_index", r6(ctr["lat"]).alias("center_lat"),
                        r6(ctr["lon"]).alias("center_lon"))


@register("cell_disk", _lv(LC) + f"""
SELECT h3_index, lower(hex({Q.packed('q + dq', 'r + dr')})) AS disk_index
FROM (SELECT DISTINCT h3_index, q, r FROM lc) c,
  (SELECT a AS dq, b AS dr FROM range(-1, 2) t1(a), range(-1, 2) t2(b) WHERE abs(a + b) <= 1) o""")
def q_cell_disk(spark, sf):
    cells = listings(spark, sf).select(geo.cell_index().alias("h3_index")).distinct()
    ax = geo.cell_unpack("h3_index")
    # the struct column is materialised before the generator: a struct built
    # in the same select as an explode loses its field names
    return (cells.select("h3_index", ax.alias("_ax"))
            .select("h3_index", "_ax", F.explode(geo.disk_offsets(1)).alias("_o"))
            .select("h3_index", geo.cell_id(F.col("_ax.q") + F.col("_o.dq"),
                                            F.col("_ax.r") + F.col("_o.dr")).alias("disk_index")))


@register("cell_boundary", _lv(LC) + f"""
SELECT h3_index, CAST(i AS BIGINT) AS corner,
  ROUND(clat + {geo.sql_literal(geo.EDGE)} * sin(radians({geo.sql_literal(60.0)} * i - {geo.sql_literal(30.0)})) / {geo.sql_literal(geo.KY)}, 6) AS lat,
  ROUND(clon + {geo.sql_literal(geo.EDGE)} * cos(radians({geo.sql_literal(60.0)} * i - {geo.sql_literal(30.0)})) / {geo.sql_literal(geo.KX)}, 6) AS lon
FROM (SELECT h3_index,
  {geo.sql_literal(37.7749)} + ({geo.sql_literal(geo.EDGE)} * ({geo.sql_literal(1.5)} * r)) / {geo.sql_literal(geo.KY)} AS clat,
  {geo.sql_literal(-122.4194)} + ({geo.sql_literal(geo.EDGE)} * ({geo.sql_literal(geo.SQRT3)} * q + {geo.sql_literal(geo.SQRT3 / 2.0)} * r)) / {geo.sql_literal(geo.KX)} AS clon
  FROM (SELECT DISTINCT h3_index, q, r FROM lc) d) c, range(0, 6) t(i)""")
def q_cell_boundary(spark, sf):
    cells = listings(spark, sf).select(geo.cell_index().alias("h3_index")).distinct()
    ax = geo.cell_unpack("h3_index")
    return (cells.select("h3_index", F.posexplode(geo.cell_boundary(ax["q"], ax["r"])))
            .select("h3_index", F.col("pos").cast("bigint").alias("corner"),
                    r6(F.col("col.lat")).alias("lat"), r6(F.col("col.lon")).alias("lon")))


def _geojson_sql():
    lit = geo.sql_literal
    clat = f"{lit(37.7749)} + ({lit(geo.EDGE)} * ({lit(1.5)} * r)) / {lit(geo.KY)}"
    clon = f"{lit(-122.4194)} + ({lit(geo.EDGE)} * ({lit(geo.SQRT3)} * q + {lit(geo.SQRT3 / 2.0)} * r)) / {lit(geo.KX)}"
    ang = f"radians({lit(60.0)} * i - {lit(30.0)})"
    corner = (f"[ROUND(({clon}) + {lit(geo.EDGE)} * cos({ang}) / {lit(geo.KX)}, 7), "
              f"ROUND(({clat}) + {lit(geo.EDGE)} * sin({ang}) / {lit(geo.KY)}, 7)]")
    return _lv(LC) + f"""
, cs AS (SELECT h3_index, q, r, ROUND(SUM(price), 2) / COUNT(price) AS value, COUNT(price) AS count
  FROM lc WHERE h3_index IS NOT NULL GROUP BY h3_index, q, r),
ring AS (SELECT h3_index, list({corner} ORDER BY i) AS pts FROM cs, range(0, 6) t(i) GROUP BY h3_index)
SELECT cs.h3_index, cs.value, cs.count,
  CAST(to_json({{'type': 'Feature', 'geometry': {{'type': 'Polygon', 'coordinates': [list_concat(ring.pts, [ring.pts[1]])]}},
    'properties': {{'h3_index': cs.h3_index, 'value': cs.value, 'count': cs.count}}}}) AS VARCHAR) AS feature
FROM cs JOIN ring ON cs.h3_index = ring.h3_index""".replace("\n, cs AS", ", cs AS", 1)


@register("cell_geojson", _geojson_sql())
def q_cell_geojson(spark, sf):
    return SP.cell_geojson(listings(spark, sf))


@register("all_spatial_features", _lv(LC) + f"""
SELECT id, h3_index, CAST({Q.packed('q', 'r')} AS BIGINT) AS h3_numeric,
  ROUND({Q.dist_center()}, 6) AS distance_to_center_km FROM lc""")
def q_all_spatial(spark, sf):
    return SP.add_all_spatial_features(listings(spark, sf)).select(
        "id", "h3_index", "h3_numeric", r6(F.col("distance_to_center_km")).alias("distance_to_center_km"))


@register("nearest_property", LV + """
SELECT point_id, id, ROUND(d, 12) AS sq_dist FROM (
  SELECT p.point_id, l.id, pow(l.lat - p.plat, 2) + pow(l.lon - p.plon, 2) AS d,
    row_number() OVER (PARTITION BY p.point_id ORDER BY pow(l.lat - p.plat, 2) + pow(l.lon - p.plon, 2), l.id) AS rn
  FROM (SELECT zip_code AS point_id, ROUND(SUM(lat), 5) / COUNT(lat) AS plat, ROUND(SUM(lon), 5) / COUNT(lon) AS plon
        FROM listings GROUP BY zip_code) p, listings l) x WHERE rn = 1""")
def q_nearest_property(spark, sf):
    ls = listings(spark, sf)
    pts = ls.groupBy(F.col("zip_code").alias("point_id")).agg(
        (F.round(F.sum("lat"), 5) / F.count("lat")).alias("plat"),
        (F.round(F.sum("lon"), 5) / F.count("lon")).alias("plon"))
    out = SP.nearest_property(ls, pts)
    return out.select("point_id", "id", F.round("sq_dist", 12).alias("sq_dist"))


# ------------------------------------------------------------------ A3, A4, J2

@register("cell_stats", _lv(LC, LCP) + """
SELECT h3_index, ROUND(median(price_per_sqft), 6) AS h3_median_ppsf,
  ROUND(AVG(price_per_sqft), 6) AS h3_mean_ppsf, ROUND(stddev_samp(price_per_sqft), 4) AS h3_std_ppsf,
  COUNT(price_per_sqft) AS h3_listing_density, ROUND(median(price), 6) AS h3_median_price,
  MIN(price) AS h3_min_price, MAX(price) AS h3_max_price
FROM lcp WHERE h3_index IS NOT NULL GROUP BY h3_index""")
def q_cell_stats(spark, sf):
    c = SP.cell_stats(listings(spark, sf))
    return c.select("h3_index", r6(F.col("h3_median_ppsf")).alias("h3_median_ppsf"),
                    r6(F.col("h3_mean_ppsf")).alias("h3_mean_ppsf"),
                    F.round("h3_std_ppsf", 4).alias("h3_std_ppsf"), "h3_listing_density",
                    r6(F.col("h3_median_price")).alias("h3_median_price"),
                    "h3_min_price", "h3_max_price")


@register("cell_feature_store", _lv(LC, LCP) + """
SELECT h3_index, ROUND(median(price_per_sqft), 6) AS median_ppsf,
  ROUND(AVG(price_per_sqft), 6) AS mean_ppsf, ROUND(stddev_samp(price_per_sqft), 4) AS std_ppsf,
  COUNT(price_per_sqft) AS listing_count, ROUND(median(price), 6) AS median_price,
  ROUND(SUM(price), 2) / COUNT(price) AS mean_price, median(sqft) AS median_sqft, median(bedrooms) AS median_bedrooms
FROM lcp WHERE h3_index IS NOT NULL GROUP BY h3_index""")
def q_cell_feature_store(spark, sf):
    ls = listings(spark, sf)
    n = SP.add_cell_index(ls).groupBy("h3_index").agg(F.count("price").alias("listing_n"))
    c = SP.cell_feature_store(ls).join(n, "h3_index")
    return c.select("h3_index", r6(F.col("median_ppsf")).alias("median_ppsf"),
                    r6(F.col("mean_ppsf")).alias("mean_ppsf"), F.round("std_ppsf", 4).alias("std_ppsf"),
                    "listing_count", r6(F.col("median_price")).alias("median_price"),
                    (F.round(F.col("mean_price") * F.col("listing_n"), 2) / F.col("listing_n")).alias("mean_price"),
                    F.col("median_sqft").cast("double").alias("median_sqft"),
                    F.col("median_bedrooms").cast("double").alias("median_bedrooms"))


@register("cell_stats_join", _lv(LC, LCP) + """
SELECT l.id, l.h3_index, ROUND(c.m, 6) AS h3_median_ppsf, c.n AS h3_listing_density
FROM lcp l LEFT JOIN (SELECT h3_index, median(price_per_sqft) AS m, COUNT(price_per_sqft) AS n
  FROM lcp WHERE h3_index IS NOT NULL GROUP BY h3_index) c ON l.h3_index = c.h3_index""")
def q_cell_stats_join(spark, sf):
    ls = SP.add_cell_index(listings(spark, sf))
    cells = SP.cell_stats(ls)
    return (ls.join(cells, "h3_index", "left")
            .select("id", "h3_index", r6(F.col("h3_median_ppsf")).alias("h3_median_ppsf"),
                    "h3_listing_density"))


# ------------------------------------------------------------------ J3, J4

CELLS = """cells AS (SELECT h3_index, q, r, median(price_per_sqft) AS h3_median_ppsf,
  COUNT(price_per_sqft) AS h3_listing_density, median(price) AS h3_median_price
  FROM lcp WHERE h3_index IS NOT NULL GROUP BY h3_index, q, r)"""
NB = """nb AS (SELECT a.h3_index, CASE WHEN SUM(b.h3_listing_density) > 0
    THEN SUM(b.h3_median_ppsf * b.h3_listing_density ORDER BY b.h3_median_ppsf * b.h3_listing_density)
      / SUM(b.h3_listing_density)
    ELSE median(b.h3_median_ppsf) END AS h3_neighbor_median_ppsf
  FROM cells a JOIN cells b ON abs(b.q - a.q) <= 1 AND abs(b.r - a.r) <= 1
    AND abs((b.q - a.q) + (b.r - a.r)) <= 1 AND NOT (b.q = a.q AND b.r = a.r)
  GROUP BY a.h3_index)"""


@register("neighbor_ppsf", _lv(LC, LCP, CELLS, NB) + """
SELECT h3_index, ROUND(h3_neighbor_median_ppsf, 6) AS h3_neighbor_median_ppsf FROM nb""")
def q_neighbor_ppsf(spark, sf):
    n = SP.neighbor_ppsf(SP.cell_stats(listings(spark, sf)))
    return n.select("h3_index", r6(F.col("h3_neighbor_median_ppsf")).alias("h3_neighbor_median_ppsf"))


@register("neighborhood_stats", _lv(LC, LCP) + """
, cm AS (SELECT h3_index, q, r, CAST(SUM(CAST(price AS DECIMAL(28, 4))) AS DOUBLE) / COUNT(price) AS m, COUNT(price) AS n FROM lcp
  WHERE h3_index IS NOT NULL GROUP BY h3_index, q, r),
agg AS (SELECT a.h3_index, SUM(b.m ORDER BY b.m) / COUNT(b.m) AS neighborhood_avg_price, SUM(b.n) AS neighborhood_count
  FROM cm a JOIN cm b ON abs(b.q - a.q) <= 1 AND abs(b.r - a.r) <= 1
    AND abs((b.q - a.q) + (b.r - a.r)) <= 1 GROUP BY a.h3_index)
SELECT l.id, agg.neighborhood_avg_price,
  CAST(agg.neighborhood_count AS BIGINT) AS neighborhood_count
FROM lcp l LEFT JOIN agg ON l.h3_index = agg.h3_index""".replace("\n, cm AS", ", cm AS", 1))
def q_neighborhood_stats(spark, sf):
    """Not rounded: both engines do the same few operations in the same order,
    while their roundings of a double at a tie differ."""
    out = SP.neighborhood_stats(listings(spark, sf))
    return out.select("id", "neighborhood_avg_price",
                      F.col("neighborhood_count").cast("bigint").alias("neighborhood_count"))


# ------------------------------------------------------------------ W1, A20, E3

PCT = """pct AS (SELECT id, h3_index, price,
  CASE WHEN h3_index IS NULL OR COUNT(*) OVER (PARTITION BY h3_index) <= 1 THEN CAST(50 AS DOUBLE)
       WHEN price IS NULL THEN CAST(0 AS DOUBLE)
       ELSE (rank() OVER (PARTITION BY h3_index ORDER BY price ASC NULLS LAST) - 1) * CAST(100 AS DOUBLE)
            / COUNT(*) OVER (PARTITION BY h3_index) END AS h3_price_percentile
  FROM lcp)"""


@register("cell_price_percentile", _lv(LC, LCP, PCT) + """
SELECT id, ROUND(h3_price_percentile, 6) AS h3_price_percentile FROM pct""")
def q_cell_price_percentile(spark, sf):
    out = SP.cell_price_percentile(SP.add_cell_index(listings(spark, sf)))
    return out.select("id", r6(F.col("h3_price_percentile")).alias("h3_price_percentile"))


LAGS = """lags AS (SELECT l.id, c.h3_median_ppsf, n.h3_neighbor_median_ppsf,
  CAST(c.h3_listing_density AS DOUBLE) AS h3_listing_density, p.h3_price_percentile
  FROM lcp l LEFT JOIN cells c ON l.h3_index = c.h3_index
  LEFT JOIN nb n ON l.h3_index = n.h3_index LEFT JOIN pct p ON l.id = p.id)"""


@register("spatial_lags", _lv(LC, LCP, CELLS, NB, PCT, LAGS) + """
SELECT id,
  ROUND(coalesce(h3_median_ppsf, median(h3_median_ppsf) OVER ()), 6) AS h3_median_ppsf,
  ROUND(coalesce(h3_neighbor_median_ppsf, median(h3_neighbor_median_ppsf) OVER ()), 6) AS h3_neighbor_median_ppsf,
  ROUND(coalesce(h3_listing_density, median(h3_listing_density) OVER ()), 6) AS h3_listing_density,
  ROUND(coalesce(h3_price_percentile, median(h3_price_percentile) OVER ()), 6) AS h3_price_percentile
FROM lags""")
def q_spatial_lags(spark, sf):
    out = SP.spatial_lags(listings(spark, sf))
    return out.select("id", *[r6(F.col(c)).alias(c) for c in SP.LAG_COLS])


@register("fill_with_median", _lv(LC, LCP, CELLS, NB) + """
SELECT l.h3_index,
  ROUND(coalesce(n.h3_neighbor_median_ppsf, median(n.h3_neighbor_median_ppsf) OVER ()), 6) AS h3_neighbor_median_ppsf
FROM (SELECT DISTINCT h3_index FROM lcp) l LEFT JOIN nb n ON l.h3_index = n.h3_index""")
def q_fill_with_median(spark, sf):
    cells = stage(SP.cell_stats(listings(spark, sf)), "fill_cells")  # one row a cell, read by both sides
    j = stage(cells.select("h3_index").join(SP.neighbor_ppsf(cells), "h3_index", "left"), "fill_joined")
    out = SP.fill_with_median(j, ["h3_neighbor_median_ppsf"])
    return out.select("h3_index", r6(F.col("h3_neighbor_median_ppsf")).alias("h3_neighbor_median_ppsf"))


# ------------------------------------------------------------------ P2, P3, A2, J5, W2, E2, P12

@register("derived_features", LV + """
SELECT id, 2025 - year_built AS property_age,
  ROUND(sqft / greatest(bedrooms, 1), 6) AS sqft_per_bedroom,
  CAST(year_built >= 2000 AS INTEGER) AS is_newer_construction FROM listings""")
def q_derived(spark, sf):
    out = FE.derived_features(listings(spark, sf))
    return out.select("id", "property_age", r6(F.col("sqft_per_bedroom")).alias("sqft_per_bedroom"),
                      "is_newer_construction")


@register("price_per_sqft", LV + """
SELECT id, ROUND(price / NULLIF(sqft, 0), 6) AS price_per_sqft FROM listings""")
def q_ppsf(spark, sf):
    return FE.price_per_sqft(listings(spark, sf)).select("id", r6(F.col("price_per_sqft")).alias("price_per_sqft"))


TIERS = """zm AS (SELECT zip_code, median(price) AS zip_median FROM listings
  WHERE zip_code IS NOT NULL GROUP BY zip_code),
e AS (SELECT quantile_cont(zip_median, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM zm),
tiers AS (SELECT zip_code, CAST(CASE WHEN zip_median <= q[2] THEN 1 WHEN zip_median <= q[3] THEN 2
  WHEN zip_median <= q[4] THEN 3 WHEN zip_median <= q[5] THEN 4 WHEN zip_median <= q[6] THEN 5 END AS INTEGER)
  AS neighborhood_price_tier FROM zm, e)"""


@register("price_tier", _lv(TIERS) + "SELECT zip_code, neighborhood_price_tier FROM tiers")
def q_price_tier(spark, sf):
    return FE.zip_price_tiers(listings(spark, sf))


@register("tier_join", _lv(TIERS) + """
SELECT l.id, CAST(coalesce(t.neighborhood_price_tier, 3) AS INTEGER) AS neighborhood_price_tier
FROM listings l LEFT JOIN tiers t ON l.zip_code = t.zip_code""")
def q_tier_join(spark, sf):
    return FE.add_price_tier(listings(spark, sf)).select("id", "neighborhood_price_tier")


@register("rank_first_tier", _lv("""zm AS (SELECT zip_code, median(price) AS zip_median FROM listings
  WHERE zip_code IS NOT NULL GROUP BY zip_code)""") + """
SELECT zip_code, CAST(CASE WHEN n <= 1 THEN 1 ELSE greatest(ceil((rk - 1) * least(5, n) / (n - 1)), 1) END AS INTEGER) AS rank_tier
FROM (SELECT zip_code, row_number() OVER (ORDER BY zip_median, zip_code) AS rk, COUNT(*) OVER () AS n FROM zm) x""")
def q_rank_first_tier(spark, sf):
    """The rank(method='first') tiering used when quintile edges collide,
    evaluated on the zip-median table (one row per zip)."""
    return FE.rank_first_tiers(FE.zip_medians(listings(spark, sf))).select("zip_code", "rank_tier")


@register("add_v2_features", _lv(TIERS) + f"""
SELECT l.id, 2025 - year_built AS property_age, ROUND(sqft / greatest(bedrooms, 1), 6) AS sqft_per_bedroom,
  CAST(year_built >= 2000 AS INTEGER) AS is_newer_construction,
  ROUND({Q.dist_center('l.lat', 'l.lon')}, 6) AS distance_to_downtown_km,
  ROUND({Q.dist_station('l.lat', 'l.lon')}, 6) AS distance_to_nearest_bart_km,
  CAST(coalesce(t.neighborhood_price_tier, 3) AS INTEGER) AS neighborhood_price_tier
FROM listings l LEFT JOIN tiers t ON l.zip_code = t.zip_code""")
def q_add_v2(spark, sf):
    out = FE.add_v2_features(listings(spark, sf))
    return out.select("id", "property_age", r6(F.col("sqft_per_bedroom")).alias("sqft_per_bedroom"),
                      "is_newer_construction",
                      r6(F.col("distance_to_downtown_km")).alias("distance_to_downtown_km"),
                      r6(F.col("distance_to_nearest_bart_km")).alias("distance_to_nearest_bart_km"),
                      "neighborhood_price_tier")
