"""All registered queries of the dialogue engine, by name, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import browse, dialogue, ingestion, registry, results, search, visits

MODULES = (search, browse, dialogue, ingestion, results, visits)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["turn_search_neighbors"](spark, sf_dir)


def queries() -> dict[str, registry.Query]:
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return registry.ORACLES
