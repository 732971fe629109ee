"""All queries over the driver's tables, by name, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netloom.plans import catalog_composites, catalog_core, catalog_eval  # noqa: F401  registers its queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated top-k edges of the embeddings' positions."""
    return catalog_core.QUERIES["topk_edges"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalog_core.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalog_core.SQL)
