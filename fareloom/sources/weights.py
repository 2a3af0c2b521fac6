"""Route weights as a small dimension table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def route_weights(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    """``route, weight`` of a configured mapping (kept inline, so its size is known)."""
    rows = ", ".join(f"('{route}', {float(weight)!r}D)" for route, weight in weights.items())
    if not rows:
        return spark.sql("SELECT '' AS route, 0D AS weight WHERE false")
    return spark.sql(f"SELECT * FROM VALUES {rows} AS w(route, weight)")


def weight_versions(spark: SparkSession, versions: dict[str, dict[str, float]]) -> DataFrame:
    """``version, route, weight`` of several mappings."""
    rows = ", ".join(f"('{version}', '{route}', {float(weight)!r}D)"
                     for version, table in versions.items() for route, weight in table.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS w(version, route, weight)")
