"""Validation, imputation, outlier explanation and data-quality reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valora.functions import stats as ST
from valora import params as P


class DataValidationError(Exception):
    """Raised when data fails a critical check."""


class NegativePriceError(DataValidationError):
    pass


class FutureYearBuiltError(DataValidationError):
    pass


# ---------------------------------------------------------------- column names

def clean_name(name: str) -> str:
    """strip -> lower -> non [a-z0-9] to '_' -> collapse '_' -> trim '_'."""
    s = re.sub(r"[^a-z0-9]", "_", name.strip().lower())
    return re.sub(r"_+", "_", s).strip("_")


def clean_column_names(df: DataFrame) -> DataFrame:
    """Metadata-only rename; raises on collisions."""
    new = [clean_name(c) for c in df.columns]
    if len(set(new)) != len(new):
        raise ValueError(f"column names collide after cleaning: {new}")
    return df.toDF(*new)


# ------------------------------------------------------------ critical checks

def critical_constraint_counts(df: DataFrame, current_year: int = P.CURRENT_YEAR) -> DataFrame:
    """One row: counts of negative prices / future build years and the first
    10 offending ids of each (two ``orderBy(id).limit(10)`` top-k scans, so
    never more than 10 ids are collected)."""
    neg = df.where(F.col("price") < 0)
    fut = df.where(F.col("year_built") > current_year)
    counts = df.agg(F.count_if(F.col("price") < 0).alias("negative_price_count"),
                    F.count_if(F.col("year_built") > current_year).alias("future_year_count"))
    ids_neg = neg.select("id").orderBy("id").limit(10).agg(
        F.sort_array(F.collect_list("id")).alias("negative_price_ids"))
    ids_fut = fut.select("id").orderBy("id").limit(10).agg(
        F.sort_array(F.collect_list("id")).alias("future_year_ids"))
    return counts.crossJoin(ids_neg).crossJoin(ids_fut)  # three 1-row sides


def validate_critical_constraints(df: DataFrame, current_year: int = P.CURRENT_YEAR) -> DataFrame:
    """Action: raise a typed error (price first, then year); return ``df``."""
    row = critical_constraint_counts(df, current_year).first()
    if row["negative_price_count"] > 0:
        raise NegativePriceError(
            f"CRITICAL: Found {row['negative_price_count']} records with negative prices. "
            f"IDs: {list(row['negative_price_ids'])}...")
    if row["future_year_count"] > 0:
        raise FutureYearBuiltError(
            f"CRITICAL: Found {row['future_year_count']} records with year_built > "
            f"{current_year}. IDs: {list(row['future_year_ids'])}...")
    return df


# ------------------------------------------------------------ schema checks

LISTING_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()), T.StructField("price", T.DoubleType()),
    T.StructField("sqft", T.DoubleType()), T.StructField("bedrooms", T.IntegerType()),
    T.StructField("year_built", T.IntegerType()), T.StructField("zip_code", T.StringType()),
    T.StructField("condition", T.IntegerType()),
])


def _rules(current_year: int) -> list[tuple[str, str, Column]]:
    """(column, check, violated?) triples of the listing contract."""
    V = P.VALIDATION

    def rng(c, lo, hi, nullable):
        col = F.col(c)
        bad = (col < lo) | (col > hi)
        if not nullable:
            bad = col.isNull() | bad
        return F.coalesce(bad, F.lit(False))
    return [
        ("id", "not_null_ge_0", F.coalesce(F.col("id").isNull() | (F.col("id") < 0), F.lit(False))),
        ("lat", "in_range(-90,90)", rng("lat", -90, 90, True)),
        ("lon", "in_range(-180,180)", rng("lon", -180, 180, True)),
        ("price", f"in_range({V['price_min']},{V['price_max']})",
         rng("price", V["price_min"], V["price_max"], False)),
        ("sqft", f"in_range({V['sqft_min']},{V['sqft_max']})",
         rng("sqft", V["sqft_min"], V["sqft_max"], True)),
        ("bedrooms", f"in_range({V['bedrooms_min']},{V['bedrooms_max']})",
         rng("bedrooms", V["bedrooms_min"], V["bedrooms_max"], False)),
        ("year_built", f"in_range({V['year_built_min']},{current_year})",
         rng("year_built", V["year_built_min"], current_year, False)),
        ("condition", f"in_range({V['condition_min']},{V['condition_max']})",
         rng("condition", V["condition_min"], V["condition_max"], False)),
    ]


def coerce_listing_schema(df: DataFrame) -> DataFrame:
    """Cast declared columns (extra columns kept)."""
    return df.withColumns({f.name: F.col(f.name).cast(f.dataType)
                           for f in LISTING_SCHEMA.fields if f.name in df.columns})


def schema_violations(df: DataFrame, current_year: int = P.CURRENT_YEAR) -> DataFrame:
    """Long table (id, column, check, value) of every contract violation.

    Row-local: an array of optional violation structs per row, filtered and
    inlined; no shuffle.
    """
    df = coerce_listing_schema(df)
    items = [F.when(bad, F.struct(F.lit(c).alias("column"), F.lit(chk).alias("check"),
                                  F.col(c).cast("string").alias("value")))
             for c, chk, bad in _rules(current_year) if c in df.columns]
    return (df.select("id", F.filter(F.array(*items), lambda x: x.isNotNull()).alias("_v"))
            .select("id", F.inline("_v")))


def raw_schema_check(df: DataFrame, current_year: int = P.CURRENT_YEAR) -> DataFrame:
    """Looser pre-check: price >= 0 and year_built <= current year."""
    items = [F.when(F.col("price") < 0, F.struct(F.lit("price").alias("column"),
                                                 F.lit("ge(0)").alias("check"),
                                                 F.col("price").cast("string").alias("value"))),
             F.when(F.col("year_built") > current_year,
                    F.struct(F.lit("year_built").alias("column"),
                             F.lit(f"le({current_year})").alias("check"),
                             F.col("year_built").cast("string").alias("value")))]
    return (df.select("id", F.filter(F.array(*items), lambda x: x.isNotNull()).alias("_v"))
            .select("id", F.inline("_v")))


# ------------------------------------------------------------ imputation

def impute_sqft(df: DataFrame) -> DataFrame:
    """NULL sqft -> zip median -> overall median; ``sqft_imputed`` = was NULL.

    Zip medians are one row per zip (broadcast-sized by construction; AQE
    still decides), the overall median one row.
    """
    zip_med = ST.quantiles(df.where(F.col("zip_code").isNotNull()), ["zip_code"], {"_zip_med": ("sqft", 0.5)})
    overall = ST.quantiles(df, [], {"_all_med": ("sqft", 0.5)})
    out = (df.join(zip_med, "zip_code", "left")
           .crossJoin(F.broadcast(overall)))
    return (out.withColumn("sqft_imputed", F.col("sqft").isNull())
            .withColumn("sqft", F.coalesce("sqft", "_zip_med", "_all_med"))
            .drop("_zip_med", "_all_med"))


def impute_condition(df: DataFrame, current_year: int = P.CURRENT_YEAR) -> DataFrame:
    """NULL condition from age: <10 -> 5, <25 -> 4, <50 -> 3, <75 -> 2, else 1."""
    if "condition" not in df.columns:
        return df.withColumn("condition", F.lit(3))
    age = F.lit(current_year) - F.col("year_built")
    guess = (F.when(age < 10, 5).when(age < 25, 4).when(age < 50, 3)
             .when(age < 75, 2).otherwise(1))
    return df.withColumn("condition", F.coalesce(F.col("condition"), guess).cast("int"))


# ------------------------------------------------------------ outliers

def quantile_bounds(df: DataFrame, cols=("price", "sqft", "price_per_sqft")) -> DataFrame:
    """p05 / p95 (linear interpolation) per column, one row."""
    return ST.quantiles(df, [], {f"{c}_{n}": (c, p) for c in cols for n, p in (("p05", 0.05), ("p95", 0.95))})


def outlier_reasons(df: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """Reason text for flagged rows (all rows of ``flagged`` or of ``df``).

    Percentiles come from the whole table (1 row, broadcast) -- not recomputed
    per row.
    """
    b = quantile_bounds(df)
    rows = (flagged if flagged is not None else df).crossJoin(F.broadcast(b))

    def fmt0(c):
        return F.format_number(F.col(c), 0)
    price = (F.when(F.col("price") > F.col("price_p95"),
                    F.concat(F.lit("Price > 95th pct ($"), fmt0("price_p95"), F.lit(")")))
             .when(F.col("price") < F.col("price_p05"),
                   F.concat(F.lit("Price < 5th pct ($"), fmt0("price_p05"), F.lit(")"))))
    ppsf = (F.when(F.col("price_per_sqft") > F.col("price_per_sqft_p95"), F.lit("$/sqft > 95th pct"))
            .when(F.col("price_per_sqft") < F.col("price_per_sqft_p05"), F.lit("$/sqft < 5th pct")))
    sqft = (F.when(F.col("sqft") > F.col("sqft_p95"),
                   F.concat(F.lit("Sqft > 95th pct ("), fmt0("sqft_p95"), F.lit(")")))
            .when(F.col("sqft") < F.col("sqft_p05"),
                  F.concat(F.lit("Sqft < 5th pct ("), fmt0("sqft_p05"), F.lit(")"))))
    reason = F.concat_ws("; ", price, ppsf, sqft)
    return (rows.withColumn("reason", F.when(reason == "", F.lit("Multivariate anomaly"))
                            .otherwise(reason))
            .drop(*b.columns))


def clean_training_data(df: DataFrame, exclude_outliers: bool = True) -> DataFrame:
    return df.where(~F.col("is_outlier")) if exclude_outliers else df


def outlier_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_records"),
                  F.count_if(F.col("is_outlier")).alias("flagged_outliers")) \
        .withColumn("pct_outliers",
                    F.round(F.col("flagged_outliers") * 100.0 / F.col("total_records"), 4))


# ------------------------------------------------------------ quality report

def quality_report(df: DataFrame) -> DataFrame:
    """Long table: one row per column with dtype, null count/%, and numeric
    min/max/mean/median/std -- computed by ONE aggregate over all columns and
    unpivoted with ``stack``."""
    numeric = {f.name for f in df.schema.fields
               if isinstance(f.dataType, (T.NumericType,))}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in df.columns:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"))
        if c in numeric:
            x = F.col(c).cast("double")
            # mean = sum / count with the sum rounded to 1e-6, which makes the
            # result independent of summation order for <= 6-decimal data
            aggs += [F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"),
                     (F.round(F.sum(x), 6) / F.count(x)).alias(f"{c}__mean"),
                     F.stddev_samp(x).alias(f"{c}__std")]
    wide = df.agg(*aggs)
    medians = {f"{c}__median": (c, 0.5) for c in df.columns if c in numeric}
    if medians:
        wide = wide.crossJoin(F.broadcast(ST.quantiles(df, [], medians)))  # one row each
    dtypes = dict(df.dtypes)
    structs = []
    for c in df.columns:
        def g(k):
            return F.col(f"{c}__{k}") if c in numeric else F.lit(None).cast("double")
        structs.append(F.struct(
            F.lit(c).alias("column"), F.lit(dtypes[c]).alias("dtype"),
            F.col(f"{c}__nulls").alias("null_count"),
            (F.col(f"{c}__nulls") * 100.0 / F.col("_rows")).alias("null_pct"),
            g("min").alias("min"), g("max").alias("max"), g("mean").alias("mean"),
            g("median").alias("median"), g("std").alias("std")))
    return wide.select(F.col("_rows").alias("total_records"),
                       F.inline(F.array(*structs)))
