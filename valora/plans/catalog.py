"""Query catalog: every registered operator query and its DuckDB oracle.

Each query reads the driver tables under ``sf_dir`` (or views Spark derives
from them) in full, so its work grows with the data.  Oracle SQL inlines the
derived views as CTEs because only the raw tables exist on the oracle side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from valora.sources.tables import oracle_cte

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def with_views(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` prefix for oracle SQL."""
    return "WITH " + ",\n".join(f"{n} AS ({oracle_cte(n)})" for n in names) + "\n"


def load_all() -> None:
    """Import every query module so that its registrations run."""
    from valora.plans import (  # noqa: F401
        q_market, q_quality, q_spatial, q_comps, q_text, q_ml, q_contrib, q_audit, q_pipelines,
    )
