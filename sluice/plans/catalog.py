"""Every registered query of the library proper, with its oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.plans import actions, commits, details, digests, estimates, intake, kinds, packages, page_items, relational, sites, sorting, texts
from sluice.streaming import arrivals, correlate

MODULES = (relational, estimates, packages, intake, details, kinds, page_items, sorting, texts, digests, actions, commits, sites, arrivals, correlate)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-scenario bids by category."""
    return estimates.scenario_bids(spark, sf_dir)
