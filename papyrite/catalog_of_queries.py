"""The library's registered queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papyrite.plans import REGISTRIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyrite.plans.search import search_hybrid

    return search_hybrid(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: function for registry in REGISTRIES for name, function in registry.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for registry in REGISTRIES for name, sql in registry.sql.items()}
