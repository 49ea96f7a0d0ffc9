"""All queries of the library over the test tables, with equal SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bookflow.jobs import model_queries, storage_queries  # noqa: F401 (they register their queries)
from bookflow.jobs.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean forward return by decile of top-of-book imbalance, per symbol."""
    return QUERIES["imbalance_deciles"](spark, sf_dir)
