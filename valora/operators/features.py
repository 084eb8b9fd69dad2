"""Derived listing features (V2.2 feature set) and walkability heuristics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valora.functions import stats as ST
from valora import params as P
from valora.functions import geo
from valora.session import stage


def derived_features(df: DataFrame, feature_year: int = P.FEATURE_YEAR) -> DataFrame:
    """property_age, sqft_per_bedroom, is_newer_construction (row-local)."""
    return df.withColumns({
        "property_age": F.lit(feature_year) - F.col("year_built"),
        "sqft_per_bedroom": F.col("sqft") / F.greatest(F.col("bedrooms"), F.lit(1)),
        "is_newer_construction": (F.col("year_built") >= 2000).cast("int"),
    })


def price_per_sqft(df: DataFrame) -> DataFrame:
    """price / sqft with sqft = 0 treated as missing."""
    return df.withColumn("price_per_sqft", F.col("price") / F.nullif(F.col("sqft"), F.lit(0.0)))


def distance_features(df: DataFrame) -> DataFrame:
    """Distance to the centre and to the nearest station.  The 8 station
    distances are separate projected columns before ``least`` so the
    generated code stays small."""
    out = df.withColumn("distance_to_downtown_km", geo.distance_to_center())
    tmp = [f"_st{i}" for i in range(len(P.STATIONS))]
    out = out.withColumns({t: geo.haversine_km("lat", "lon", F.lit(a), F.lit(b))
                           for t, (_, a, b) in zip(tmp, P.STATIONS)})
    return out.withColumn("distance_to_nearest_bart_km", F.least(*[F.col(t) for t in tmp])).drop(*tmp)


def zip_price_tiers(df: DataFrame, q: int = 5) -> DataFrame:
    """zip_code -> tier 1..5 from quintiles of zip median prices.

    The zip-median table has one row per zip (bounded by the number of zip
    codes, not by rows).  Equal-frequency cut on the medians (right-closed,
    lowest included); when edges collide, fall back to cutting the
    first-come ranks (``rank(method='first')``) into min(q, n) bins.
    """
    med = zip_medians(df)
    probs = [i / q for i in range(0, q + 1)]
    edges = med.agg(F.percentile("zip_median", probs).alias("_e"))  # of one row per zip
    e = F.col("_e")
    distinct_edges = F.size(F.array_distinct(e)) == F.lit(q + 1)

    def cut(v, edges_col, nbins):
        # right-closed bins, first bin includes the lowest edge
        expr = F.lit(None).cast("int")
        for i in range(nbins, 0, -1):
            expr = F.when(v <= F.element_at(edges_col, i + 1), F.lit(i)).otherwise(expr)
        return expr

    return (rank_first_tiers(med, q).crossJoin(F.broadcast(edges))  # 1-row side
            .select("zip_code",
                    F.when(distinct_edges, cut(F.col("zip_median"), e, q))
                    .otherwise(F.col("rank_tier")).cast("int").alias("neighborhood_price_tier")))


def zip_medians(df: DataFrame) -> DataFrame:
    """(zip_code, zip_median) of the price, NULL zips left out."""
    return stage(ST.quantiles(df.where(F.col("zip_code").isNotNull()), ["zip_code"], {"zip_median": ("price", 0.5)}),
                 "zip_medians")


def rank_first_tiers(med: DataFrame, q: int = 5) -> DataFrame:
    """``med(zip_code, zip_median)`` with ``rank_tier``: first-come ranks 1..n
    cut at the linear quantiles of 1..n into min(q, n) tiers."""
    n = F.count(F.lit(1)).over(Window.partitionBy())  # one row per zip
    rank = F.row_number().over(Window.orderBy("zip_median", "zip_code"))
    # the smallest tier i with rank <= 1 + (n - 1) * i / k
    tier = F.greatest(F.ceil((rank - 1) * F.least(F.lit(q), n) / (n - 1)), F.lit(1))
    return med.withColumn("rank_tier", F.when(n <= 1, 1).otherwise(tier).cast("int"))


def add_price_tier(df: DataFrame) -> DataFrame:
    """Left join of the tier table (one row per zip), missing zip -> tier 3.
    The join strategy is left to AQE's runtime size check."""
    tiers = zip_price_tiers(df)
    return (df.join(tiers, "zip_code", "left")
            .withColumn("neighborhood_price_tier",
                        F.coalesce(F.col("neighborhood_price_tier"), F.lit(3)).cast("int")))


def add_v2_features(df: DataFrame, feature_year: int = P.FEATURE_YEAR) -> DataFrame:
    """V2.2: derived + distance + zip price tier."""
    return add_price_tier(distance_features(derived_features(df, feature_year)))


def feature_ranges(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, n, min, max, median, mean), one row per feature: one
    aggregate and the exact medians, unpivoted."""
    wide = df.agg(*[f(c).cast("double").alias(f"{c}__{n}") for c in features
                    for n, f in (("n", F.count), ("min", F.min), ("max", F.max), ("mean", F.avg))])
    wide = wide.crossJoin(F.broadcast(ST.quantiles(df, [], {f"{c}__median": (c, 0.5) for c in features})))  # one row each
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"{c}__n").cast("long").alias("n"),
                     *[F.round(f"{c}__{n}", 6).alias(n) for n in ("min", "max", "median", "mean")]) for c in features]
    return wide.select(F.inline(F.array(*rows)))
