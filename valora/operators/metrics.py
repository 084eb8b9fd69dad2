"""Valuation accuracy metrics as single-pass aggregates (no collect)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.functions import stats as ST


def _ape(y: str, p: str):
    return F.abs((F.col(y) - F.col(p)) / F.col(y))


def ppe(df: DataFrame, y: str = "price", p: str = "prediction",
        thresholds=(0.10, 0.20)) -> DataFrame:
    """% of rows with |y - p| / y <= t (rows with y = 0 dropped)."""
    d = df.where(F.col(y) != 0)
    return d.agg(*[F.avg(F.when(_ape(y, p) <= t, F.lit(100.0)).otherwise(F.lit(0.0)))
                   .alias(f"ppe{int(round(t * 100))}") for t in thresholds])


def mdape(df: DataFrame, y: str = "price", p: str = "prediction") -> DataFrame:
    """Median absolute percentage error x100 (y = 0 dropped)."""
    d = df.where(F.col(y) != 0)
    return ST.quantiles(d, [], {"mdape": (_ape(y, p) * 100, 0.5)})


def regression_metrics(df: DataFrame, y: str = "price", p: str = "prediction") -> DataFrame:
    """RMSE, MAE and R^2.  SST uses the exact two-pass form: a 1-row mean
    (broadcast, size proven) then one aggregate pass."""
    err = F.col(y) - F.col(p)
    ybar = df.agg(F.avg(F.col(y)).alias("_m"))
    return (df.crossJoin(F.broadcast(ybar))
            .agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
                 (1 - F.sum(err * err) / F.sum(F.pow(F.col(y) - F.col("_m"), 2))).alias("r2")))


def all_metrics(df: DataFrame, by: str, y: str = "price", p: str = "prediction") -> DataFrame:
    """RMSE, MAE, R^2, PPE10, PPE20 and MdAPE for each value of ``by``, from
    one aggregate and one rank pass over the (few) columns it needs."""
    from valora.session import stage
    d = stage(df.select(by, y, p), "metric_rows")
    err = F.col(y) - F.col(p)
    near = [F.avg(F.when(F.col(y) != 0, F.when(_ape(y, p) <= t, 100.0).otherwise(0.0))).alias(f"ppe{round(t * 100)}")
            for t in (0.10, 0.20)]
    sums = d.groupBy(by).agg(
        F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
        (1 - F.sum(err * err) / (F.var_pop(y) * F.count(y))).alias("r2"), *near)
    med = ST.quantiles(d.where(F.col(y) != 0), [by], {"mdape": (_ape(y, p) * 100, 0.5)})
    return sums.join(med, by, "left")
