"""Valuation status, display labels and mortgage/affordability columns.

All row-local Column expressions (no shuffle) except the small broadcast
lookups to fixed dimension tables built from ``params``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valora import params as P


def valuation_status(df: DataFrame, list_col: str = "price", model_col: str = "model_price") -> DataFrame:
    """delta = model - list; pct = delta / list * 100; Undervalued iff delta > 0."""
    delta = F.col(model_col) - F.col(list_col)
    return df.withColumns({
        "price_delta": delta,
        "price_delta_pct": delta / F.col(list_col) * 100,
        "valuation_status": F.when(delta > 0, F.lit("Undervalued")).otherwise(F.lit("Overvalued")),
    })


def condition_label(c: Column | str = "condition") -> Column:
    m = F.create_map(*[x for k, v in P.CONDITION_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.col(c) if isinstance(c, str) else c], F.lit("N/A"))


def property_label() -> Column:
    """``ID n: $p | s sqft | zip`` (price with thousands separators)."""
    return F.concat(F.lit("ID "), F.col("id").cast("string"), F.lit(": $"),
                    F.format_number(F.col("price"), 0), F.lit(" | "),
                    F.coalesce(F.col("sqft").cast("string"), F.lit("nan")), F.lit(" sqft | "),
                    F.coalesce(F.col("zip_code"), F.lit("None")))


def map_projection(df: DataFrame, lat_col: str = "lat", lon_col: str = "lon",
                   delta_col: str = "price_delta") -> DataFrame:
    """Map-ready columns: lat/lon under standard names and a colour by sign."""
    return df.withColumns({
        "lat": F.col(lat_col), "lon": F.col(lon_col),
        "color": F.when(F.col(delta_col) > 0, F.lit("#00D47E")).otherwise(F.lit("#FF4757")),
    })


def fixed(c: Column, digits: int) -> Column:
    """``%.{digits}f`` with round-half-even on exact binary ties, like
    Python / C formatting (Java's formatter rounds ties up)."""
    t = c * (10 ** digits)
    tie = (t - F.floor(t)) == 0.5
    return F.format_string(f"%.{digits}f", F.when(tie, F.bround(c, digits)).otherwise(c))


def currency_short(v: Column | str, base: Column | None = None) -> Column:
    """``$1.2M`` / ``$350k`` / ``$80`` with sign; '+' for positive values
    that are not the baseline."""
    v = F.col(v) if isinstance(v, str) else v
    a = F.abs(v)
    body = (F.when(a >= 1_000_000, F.concat(F.lit("$"), fixed(a / 1_000_000, 1), F.lit("M")))
            .when(a >= 1000, F.concat(F.lit("$"), fixed(a / 1000, 0), F.lit("k")))
            .otherwise(F.concat(F.lit("$"), fixed(a, 0))))
    plus = (v != 0) if base is None else ((v != base) & (v != 0))
    return (F.when(v < 0, F.concat(F.lit("-"), body))
            .when(plus, F.concat(F.lit("+"), body)).otherwise(body))


# ------------------------------------------------------------------ mortgage

def rate_environment(rate: Column | str) -> Column:
    r = F.col(rate) if isinstance(rate, str) else rate
    return (F.when(r >= 7.0, "high").when(r >= 6.0, "elevated")
            .when(r >= 5.0, "moderate").otherwise("favorable"))


def rate_impact_table(spark: SparkSession) -> DataFrame:
    """4-row fixed dimension (environment -> sentiment and impact texts)."""
    return spark.createDataFrame(
        P.RATE_IMPACT, "environment string, sentiment string, buyer_impact string, "
                       "seller_impact string, investment_note string")


def add_rate_context(df: DataFrame, spark: SparkSession, rate_col: str = "rate") -> DataFrame:
    """Environment, impact texts and changes vs 1y ago / 10y average."""
    out = df.withColumn("environment", rate_environment(rate_col))
    out = out.join(F.broadcast(rate_impact_table(spark)), "environment", "left")  # 4 rows
    yoy = F.col(rate_col) - F.lit(P.RATE_HISTORY["one_year_ago"])
    vs10 = F.col(rate_col) - F.lit(P.RATE_HISTORY["ten_year_avg"])
    return out.withColumns({
        "yoy_change": yoy, "yoy_direction": F.when(yoy > 0, "up").otherwise("down"),
        "vs_10yr_avg": vs10, "vs_10yr_direction": F.when(vs10 > 0, "above").otherwise("below"),
    })


def monthly_payment(df: DataFrame, price_col: str = "price", rate: Column | float | None = None,
                    down_pct: float = 0.20, term_years: int = 30) -> DataFrame:
    """Annuity P&I (rate 0 -> loan / n), tax 1.15 %/12, insurance 0.3 %/12."""
    rate_c = F.lit(P.CURRENT_RATES["30_year_fixed"]) if rate is None else (
        rate if isinstance(rate, Column) else F.lit(float(rate)))
    price = F.col(price_col)
    loan = price * (1 - down_pct)
    mr = rate_c / 100 / 12
    n = term_years * 12
    growth = F.pow(F.lit(1.0) + mr, F.lit(float(n)))
    pi = F.when(mr > 0, loan * (mr * growth) / (growth - 1)).otherwise(loan / n)
    tax = price * P.PROPERTY_TAX_RATE / 12
    ins = price * P.INSURANCE_RATE / 12
    return df.withColumns({
        "loan_amount": loan, "down_payment": price * down_pct, "monthly_pi": pi,
        "monthly_tax": tax, "monthly_insurance": ins, "total_monthly": pi + tax + ins,
        "rate_used": rate_c,
    })


def affordability_text(df: DataFrame, spark: SparkSession, price_col: str = "price") -> DataFrame:
    """Formatted affordability block per listing at the current 30y rate."""
    rate = P.CURRENT_RATES["30_year_fixed"]
    base = monthly_payment(df, price_col).withColumn("rate", F.lit(rate))
    ctx = add_rate_context(base, spark, "rate")

    def money(c):
        return F.concat(F.lit("$"), F.format_number(F.col(c), 0))

    def signed(c):
        return F.format_string("%+.2f%%", F.col(c))
    text = F.concat(
        F.lit("**Interest Rate Environment: "), F.upper(F.col("sentiment")), F.lit("**\n"),
        F.lit(f"Current 30-Year Fixed: {rate:.2f}% (as of {P.CURRENT_RATES['last_updated']})\n"),
        F.lit("- Year-over-Year: "), signed("yoy_change"), F.lit(" ("), F.col("yoy_direction"), F.lit(")\n"),
        F.lit("- vs 10-Year Average: "), signed("vs_10yr_avg"), F.lit(" ("), F.col("vs_10yr_direction"),
        F.lit(")\n\n**Monthly Payment Estimate** (20% down):\n- Principal & Interest: "), money("monthly_pi"),
        F.lit("\n- Est. Taxes: "), money("monthly_tax"),
        F.lit("\n- Est. Insurance: "), money("monthly_insurance"),
        F.lit("\n- **Total PITI: "), money("total_monthly"),
        F.lit("/month**\n\n**Rate Impact Assessment:**\n- Buyer Impact: "), F.col("buyer_impact"),
        F.lit("\n- Investment Note: "), F.col("investment_note"))
    return ctx.withColumn("affordability_text", text)
