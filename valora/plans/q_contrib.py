"""Operators on a contributions or score table.

The operators take any table of contributions or outlier flags.  Here it comes
from the listings by plain arithmetic, so that their answers can be checked in
SQL; the fitted model feeds the same operators in ``memo_pipeline``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from valora import params as P
from valora.operators import enrich as EN
from valora.operators import memo as ME
from valora.operators import quality as QU
from valora.operators import treeshap as TS
from valora.plans.catalog import register, with_views
from valora.plans.q_market import _news_sql
from valora.sources.tables import listings

LV = with_views("listings").rstrip("\n")
#: contribution of each feature, whole numbers
PARTS = {"sqft": "(coalesce(sqft, 2000) - 2000) * 150", "bedrooms": "(bedrooms - 3) * 40000",
         "year_built": "(year_built - 1960) * 900", "condition": "(coalesce(condition, 3) - 3) * 25000"}
BASE = 1_500_000.0
FLAG = "(id * 7919) % 100 < 5"


def contributions(spark, sf):
    """Listings with ``shap_values``, ``base_value`` and ``prediction``."""
    entries = [x for f, e in PARTS.items() for x in (F.lit(f), F.expr(e).cast("double"))]
    total = F.aggregate(F.map_values("shap_values"), F.lit(0.0), lambda t, x: t + x)
    return (listings(spark, sf).withColumn("shap_values", F.create_map(*entries))
            .withColumn("base_value", F.lit(BASE)).withColumn("prediction", F.lit(BASE) + total))


_ALL = ", ".join(f"{{'k': -abs(CAST({e} AS DOUBLE)), 'f': '{f}', 'v': CAST({e} AS DOUBLE)}}" for f, e in PARTS.items())
_SUM = " + ".join(f"CAST({e} AS DOUBLE)" for e in PARTS.values())
CONTRIB = LV + f""",
ct AS (SELECT *, list_sort([{_ALL}]) AS s, CAST({BASE} AS DOUBLE) AS base_value,
  CAST({BASE} AS DOUBLE) + ({_SUM}) AS prediction FROM listings)
"""


def _text_sql(items: str) -> str:
    return f"array_to_string(list_transform({items}, lambda x: x.f || '=' || CAST(CAST(x.v AS BIGINT) AS VARCHAR)), '|')"


def _text(items):
    return F.array_join(F.transform(items, lambda e: F.concat(
        e["feature"], F.lit("="), e["value"].cast("bigint").cast("string"))), "|")


POSITIVE = "list_filter(s, lambda x: x.v > 0)[1:3]"
NEGATIVE = "list_filter(s, lambda x: x.v < 0)[1:3]"


@register("clean_training_data", LV + f"""
SELECT id, price, sqft FROM listings WHERE NOT ({FLAG})""")
def q_clean_training(spark, sf):
    scored = listings(spark, sf).withColumn("is_outlier", F.expr(FLAG))
    return QU.clean_training_data(scored).select("id", "price", "sqft")


@register("outlier_summary", LV + f"""
SELECT COUNT(*) AS total_records, COUNT(*) FILTER (WHERE {FLAG}) AS flagged_outliers,
  ROUND(COUNT(*) FILTER (WHERE {FLAG}) * CAST(100 AS DOUBLE) / COUNT(*), 4) AS pct_outliers FROM listings""")
def q_outlier_summary(spark, sf):
    out = QU.outlier_summary(listings(spark, sf).withColumn("is_outlier", F.expr(FLAG)))
    return out.withColumn("pct_outliers", F.col("pct_outliers").cast("double"))


@register("shap_sorted", CONTRIB + f"SELECT id, {_text_sql('s')} AS contributions FROM ct")
def q_shap_sorted(spark, sf):
    return contributions(spark, sf).select("id", _text(TS.sorted_contributions()).alias("contributions"))


@register("top_drivers", CONTRIB + f"SELECT id, {_text_sql(POSITIVE)} AS positive, {_text_sql(NEGATIVE)} AS negative FROM ct")
def q_top_drivers(spark, sf):
    positive, negative = TS.top_drivers()
    return contributions(spark, sf).select("id", _text(positive).alias("positive"), _text(negative).alias("negative"))


@register("waterfall", CONTRIB.rstrip("\n") + f""",
st AS (SELECT id, base_value, prediction, list_filter(s, lambda x: abs(x.v) > 1) AS s FROM ct),
ru AS (SELECT *, list_transform(range(1, len(s) + 1), lambda i: base_value + list_sum(list_transform(s[1:i], lambda x: x.v))) AS r FROM st),
b AS (SELECT *, greatest(base_value, coalesce(list_max(r), base_value)) AS hi, least(base_value, coalesce(list_min(r), base_value)) AS lo FROM ru)
SELECT id, base_value, prediction, {_text_sql('s')} AS steps,
  array_to_string(list_transform(r, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), '|') AS running_total,
  lo - (hi - lo) * CAST(0.2 AS DOUBLE) AS y_min, hi + (hi - lo) * CAST(0.2 AS DOUBLE) AS y_max FROM b""")
def q_waterfall(spark, sf):
    out = TS.waterfall(contributions(spark, sf))
    running = F.array_join(F.transform("running_total", lambda x: x.cast("bigint").cast("string")), "|")
    return out.withColumn("steps", _text(F.col("steps"))).withColumn("running_total", running)


def _memo_input(spark, sf):
    ctx = EN.market_context_static(contributions(spark, sf), spark).withColumns(
        {"source": F.lit("static"), "rag_context": F.lit(None).cast("string")})
    return ctx.withColumn("shap_sorted", TS.sorted_contributions()).withColumnRenamed("prediction", "model_price")


_NAME, _SENT, _NEWS, _RISKS = P.DEFAULT_MARKET_NEWS
MEMO = CONTRIB.rstrip("\n") + f""",
mi AS (SELECT ct.*, coalesce(mn.neighborhood, '{_NAME}') AS neighborhood, coalesce(mn.sentiment, '{_SENT}') AS sentiment,
  string_split(coalesce(mn.news, '{' | '.join(_NEWS)}'), ' | ') AS news,
  string_split(coalesce(mn.risk_factors, '{' | '.join(_RISKS)}'), ' | ') AS risk_factors
  FROM ct LEFT JOIN {_news_sql()} ON ct.zip_code = mn.zip_code)
"""
_RATE = f"(CAST({P.CURRENT_RATES['30_year_fixed']} AS DOUBLE) / 100 / 12)"
_GROWTH = f"pow(1.0 + {_RATE}, CAST(360 AS DOUBLE))"
_PI = f"prediction * (1 - CAST(0.2 AS DOUBLE)) * ({_RATE} * {_GROWTH}) / ({_GROWTH} - 1)"


@register("memo_fields", MEMO + f"""
SELECT id, prediction AS model_price, base_value, prediction - base_value AS price_diff,
  ROUND((prediction - base_value) / base_value * 100, 6) AS price_diff_pct,
  CASE sentiment WHEN 'Bullish' THEN 'CAUTIOUS BUY' WHEN 'Bearish' THEN 'HOLD / AVOID' ELSE 'NEUTRAL' END AS recommendation,
  {_text_sql(POSITIVE)} AS positive_drivers, {_text_sql(NEGATIVE)} AS negative_drivers,
  array_to_string(news[1:2], ' | ') AS news_highlights, array_to_string(risk_factors, ' | ') AS risk_factors,
  ROUND({_PI}, 4) AS monthly_pi,
  ROUND({_PI} + prediction * CAST(0.0115 AS DOUBLE) / 12 + prediction * CAST(0.003 AS DOUBLE) / 12, 4) AS total_monthly,
  'Configure OPENAI_API_KEY for AI-powered insights.' AS source_note FROM mi""")
def q_memo_fields(spark, sf):
    out = ME.memo_fields(_memo_input(spark, sf))
    return out.select("id", "model_price", "base_value", "price_diff", F.round("price_diff_pct", 6).alias("price_diff_pct"),
                      "recommendation", _text(F.col("positive_drivers")).alias("positive_drivers"),
                      _text(F.col("negative_drivers")).alias("negative_drivers"),
                      F.array_join("news_highlights", " | ").alias("news_highlights"),
                      F.array_join("risk_factors", " | ").alias("risk_factors"),
                      F.round("monthly_pi", 4).alias("monthly_pi"), F.round("total_monthly", 4).alias("total_monthly"),
                      "source_note")


def _bullets(items: str) -> str:
    return f"array_to_string(list_transform({items}, lambda x: '  - ' || x), chr(10))"


_MONEY = "'$' || CASE WHEN x.v >= 0 THEN '+' ELSE '-' END || format('{:,.0f}', abs(x.v))"
_SHOWN = {"Square Footage": ("sqft", " sqft"), "Bedrooms": ("bedrooms", ""), "Year Built": ("year_built", ""),
          "Condition Rating": ("condition", "/5")}


@register("llm_prompt_rows", MEMO + "SELECT id, " + " || ".join([
    "'You are a Bearish Investment Analyst reviewing a residential property valuation.' || chr(10)",
    "'Return a JSON object with recommendation, valuation_summary, sentiment, risk_factors, ' "
    "|| 'market_outlook, news_highlights.' || chr(10) || chr(10) || 'PROPERTY DATA:' || chr(10)",
    "'- Model Valuation: $' || format('{:,.0f}', prediction) || chr(10) || '- Market Baseline: $' || format('{:,.0f}', base_value)",
    *[f"chr(10) || '- {title}: ' || coalesce(CAST({c} AS VARCHAR), 'N/A') || '{unit}'" for title, (c, unit) in _SHOWN.items()],
    "chr(10) || chr(10) || 'VALUATION BREAKDOWN (SHAP Analysis):' || chr(10)",
    f"array_to_string(list_transform(s, lambda x: '  - ' || x.f || ': ' || {_MONEY} || ' impact'), chr(10))",
    "chr(10) || chr(10) || 'MARKET CONTEXT - ' || neighborhood || ':' || chr(10) || 'Sentiment: ' || sentiment",
    f"chr(10) || chr(10) || 'Recent News:' || chr(10) || {_bullets('news')}",
    f"chr(10) || chr(10) || 'Known Risk Factors:' || chr(10) || {_bullets('risk_factors')} || chr(10)",
    "chr(10) || chr(10) || 'Return ONLY valid JSON. Be specific with numbers and percentages.'"])
    + " AS llm_prompt FROM mi")
def q_llm_prompts(spark, sf):
    return ME.llm_prompt_rows(_memo_input(spark, sf)).select("id", "llm_prompt")
