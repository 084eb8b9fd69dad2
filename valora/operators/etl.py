"""The ETL as a table API.

``run_etl`` takes the raw listings and a folder and leaves three tables there:
the processed features, the schema violations and the ``sales`` table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from valora.operators import features as FE
from valora.operators import iforest as IF
from valora.operators import quality as QU
from valora.operators import spatial as SP
from valora.sources import io as IO


@dataclass
class EtlResult:
    processed: DataFrame
    violations: DataFrame
    sales: DataFrame


def run_etl(raw: DataFrame, folder: str, validate: bool = True, exclude_outliers: bool = False,
            contamination: float = 0.05, leave_one_out: bool = False, sales_name: str = "sales") -> EtlResult:
    """Clean names -> critical checks -> impute -> schema violations (side
    table) -> outlier filter (optional) -> V2.2 and V3 features -> Parquet and
    the ``sales`` table.

    An empty input is an error (ValueError).  ``exclude_outliers`` drops the
    rows the isolation forest flags before the neighbourhood features, so they
    don't shape their neighbours either.  ``leave_one_out`` keeps a row's own
    price out of its cell's median."""
    df = QU.clean_column_names(raw)
    if df.limit(1).count() == 0:
        raise ValueError("no listings to process")
    if validate:
        QU.validate_critical_constraints(df)
    df = QU.impute_condition(QU.impute_sqft(df))
    violations = QU.schema_violations(df)
    if exclude_outliers:
        flagged = IF.isolation_forest(df, contamination=contamination)
        df = QU.clean_training_data(flagged).drop("anomaly_score", "is_outlier", "price_per_sqft")
    features = SP.spatial_lags(FE.add_v2_features(df), leave_one_out=leave_one_out)
    spark = raw.sparkSession
    IO.write_parquet(features, f"{folder}/processed")
    IO.write_parquet(violations, f"{folder}/violations")
    processed = spark.read.parquet(f"{folder}/processed")
    sales = IO.sales_table(processed, sales_name, f"{folder}/sales")
    return EtlResult(processed, spark.read.parquet(f"{folder}/violations"), sales)
