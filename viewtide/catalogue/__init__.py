"""All registered queries."""

from viewtide.catalogue import check_queries, forecast_queries, mart_queries, scalar_queries, tables  # noqa: F401
from viewtide.catalogue.base import Data, REGISTRY, rounded, spark_queries, sql_queries

__all__ = ["Data", "REGISTRY", "rounded", "spark_queries", "sql_queries"]
