"""Registry of the engine's queries over the driver's tables."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

MODULES = ("q_regime", "q_flow", "q_time", "q_transfer", "q_frequency", "q_sources", "q_estimators", "q_dimensions")


def _all(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"headwater.plans.{name}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flashiness and TQmean of each region and year."""
    from headwater.operators.regime import flashiness, tqmean
    from headwater.plans.tables import daily

    d = daily(spark, sf_dir)
    return flashiness(d, min_days=60).join(tqmean(d, min_days=60).select("site", "year", "tqmean"), ["site", "year"])
