"""Selector registries (JSON per site) and the healing log (JSON lines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

from ..schema import HEALING_LOG, REGISTRY


def read_registries(spark: SparkSession, root: str) -> DataFrame:
    """``site, selectors, pending_review``; a file without a site is named by its path."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    return (spark.read.schema(REGISTRY).option("multiLine", True)
            .option("pathGlobFilter", "*.json").json(root)
            .where(name != "healing_log")
            .select(F.coalesce("site", name).alias("site"), "selectors", "pending_review"))


def registry_selectors(registries: DataFrame) -> DataFrame:
    """One row per active selector: ``site, field, value, last_verified_at, ..., active``."""
    return (registries.select("site", F.explode("selectors").alias("field", "_s"))
            .select("site", "field", "_s.*", F.lit(True).alias("active")))


def read_healing_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HEALING_LOG).json(path)


def selector_health(registries: DataFrame) -> DataFrame:
    """Active and pending selectors per site."""
    def count(name: str):
        return F.coalesce(F.size(F.map_keys(name)), F.lit(0))
    return registries.select("site", count("selectors").alias("active_selectors"),
                             count("pending_review").alias("pending_selectors"))


def recent_events(log: DataFrame, limit: int = 50) -> DataFrame:
    return log.orderBy(F.col("timestamp").try_cast("timestamp").desc_nulls_last(), "site",
                       "target_field").limit(limit)


def healing_summary(log: DataFrame) -> DataFrame:
    """Attempts and success rate per (site, field), and the selector promoted last."""
    when = F.when(F.col("success"), F.col("timestamp").try_cast("timestamp"))
    return log.groupBy("site", "target_field").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if("success").alias("successes"),
        S.rounded(100 * F.count_if("success") / F.count(F.lit(1)), 1).alias("success_pct"),
        F.max_by("selector", when).alias("latest_selector"))
