"""Comparable-sales queries."""

from __future__ import annotations


from valora.operators import comps as CO
from valora.operators import quality as QU
from valora.plans.catalog import register, with_views
from valora.sources.tables import listings

IMPUTED = with_views("listings").rstrip("\n") + """
, zm AS (SELECT zip_code, median(sqft) AS m FROM listings WHERE zip_code IS NOT NULL GROUP BY zip_code),
om AS (SELECT median(sqft) AS m FROM listings),
li AS (SELECT l.id, l.zip_code, coalesce(l.sqft, zm.m, om.m) AS sqft, l.bedrooms, l.year_built, l.price
  FROM listings l LEFT JOIN zm ON l.zip_code = zm.zip_code, om WHERE l.zip_code IS NOT NULL),
SCORE_PAIRS AS (SELECT t.id AS target_id, c.id AS comp_id, c.price AS comp_price, t.price AS target_price,
  ROUND(abs(c.sqft - t.sqft) / t.sqft * CAST(0.5 AS DOUBLE) + CAST(abs(c.bedrooms - t.bedrooms) AS DOUBLE) * CAST(0.3 AS DOUBLE)
    + CAST(abs(c.year_built - t.year_built) AS DOUBLE) / 100 * CAST(0.2 AS DOUBLE), 10) AS similarity_score,
  (c.sqft >= t.sqft * CAST(0.8 AS DOUBLE) AND c.sqft <= t.sqft * CAST(1.2 AS DOUBLE)
    AND c.bedrooms BETWEEN t.bedrooms - 1 AND t.bedrooms + 1
    AND c.year_built BETWEEN t.year_built - 15 AND t.year_built + 15) AS hit
  FROM li t JOIN li c ON t.zip_code = c.zip_code AND t.id <> c.id),
matched AS (SELECT DISTINCT target_id FROM SCORE_PAIRS WHERE hit),
cand AS (SELECT p.*, false AS fallback FROM SCORE_PAIRS p WHERE hit
  UNION ALL SELECT p.*, true AS fallback FROM SCORE_PAIRS p WHERE target_id NOT IN (SELECT target_id FROM matched)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY target_id ORDER BY similarity_score, comp_id) AS BIGINT) AS rank FROM cand)
""".replace("\n, zm AS", ", zm AS", 1)


@register("comps", IMPUTED + """
SELECT target_id, comp_id, rank, similarity_score, comp_price, target_price, fallback
FROM ranked WHERE rank <= 5""")
def q_comps(spark, sf):
    return CO.find_comps(QU.impute_sqft(listings(spark, sf)))


@register("comps_fallback", IMPUTED + """
SELECT target_id, comp_id, rank, similarity_score FROM ranked WHERE rank <= 5 AND fallback""")
def q_comps_fallback(spark, sf):
    out = CO.find_comps(QU.impute_sqft(listings(spark, sf)))
    return out.where("fallback").select("target_id", "comp_id", "rank", "similarity_score")


@register("comp_summary", IMPUTED + """
SELECT target_id, COUNT(*) AS n_comps, ROUND(SUM(comp_price), 2) / COUNT(comp_price) AS avg_comp_price,
  MIN(target_price) AS target_price, MIN(target_price) AS reference_price,
  MIN(target_price) - ROUND(SUM(comp_price), 2) / COUNT(comp_price) AS comp_difference
FROM ranked WHERE rank <= 5 GROUP BY target_id""")
def q_comp_summary(spark, sf):
    return CO.comp_summary(CO.find_comps(QU.impute_sqft(listings(spark, sf))))


@register("topk_per_target", IMPUTED + """
SELECT target_id, comp_id, rank, similarity_score FROM ranked WHERE rank <= 3""")
def q_topk_per_target(spark, sf):
    """K2: best 3 comparables per target (NULL scores last, id tie-break)."""
    out = CO.find_comps(QU.impute_sqft(listings(spark, sf)), n=3)
    return out.select("target_id", "comp_id", "rank", "similarity_score")
