"""All registered queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from harvestline.registry.base import ORACLES, QUERIES

MODULES = ("q_sources", "q_rows", "q_joins", "q_aggregates", "q_series", "q_sampling", "q_models", "q_streaming")

for _m in MODULES:
    importlib.import_module(f"harvestline.registry.{_m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["forecast_flagship"](spark, sf_dir)
