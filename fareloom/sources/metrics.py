"""Stage metrics of a run, kept as JSON rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..schema import METRICS

#: the rules of the quality score and of the two outlier tests
FLAGS = ["llm_sourced", "fare_estimated", "missing_price", "stale_selector", "cross_source_confirmed",
         C.FLAG_STATISTICAL, C.FLAG_MODEL]


def scored_metrics(columns: list[str]) -> list[Column]:
    """Row count, mean scores, perfect and flagged rows, and rows per rule of the method."""
    found = [F.count(F.lit(1)).alias("rows"), F.avg("confidence_score").alias("mean_confidence_score"),
             F.count_if(F.col("confidence_score") == 1.0).alias("perfect_score_rows"),
             F.count_if(F.size("quality_flags") > 0).alias("total_flagged_rows")]
    if "anomaly_score" in columns:
        found.append(F.avg("anomaly_score").alias("mean_anomaly_score"))
    return found + [F.count_if(F.array_contains("quality_flags", flag)).alias(f"flag.{flag}") for flag in FLAGS]


def index_metrics(columns: list[str]) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
            F.max_by("composite_fare_index", "date").alias("latest_composite_index"),
            F.max_by("data_completeness", "date").alias("latest_completeness")]


def row_metrics(columns: list[str]) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows")]


def write_observed(df: DataFrame, measures: Callable[[list[str]], list[Column]],
                   write: Callable[[DataFrame], None]) -> dict:
    """Write ``df`` and return the measures of exactly the rows written, taken while they pass."""
    seen = Observation()
    write(df.observe(seen, *measures(df.columns)))
    return {name: round(value, 4) if name.startswith("mean_") and value is not None else value
            for name, value in seen.get.items() if value != 0 or not name.startswith("flag.")}


def save_metrics(spark: SparkSession, run_id: str, stage: str, seconds: float, values: dict,
                 path: str) -> None:
    flat = {k: str(v) for k, v in values.items() if k != "rows"}
    row = (run_id, stage, float(seconds), int(values.get("rows", 0)), flat)
    spark.createDataFrame([row], METRICS).coalesce(1).write.mode("append").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).json(path)
