"""Names, queries and SQL of the interval engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import boundary_queries, graph_queries, region_queries, strand_queries  # noqa: F401  they register their queries
from .plans.queries import ORACLE, QUERIES, exon_coverage


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of every exon piece per sample."""
    return exon_coverage(spark, sf_dir)
