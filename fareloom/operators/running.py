"""Running totals over long ordered groups, and runs of equal outcomes built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def running_total(df: DataFrame, keys: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """Add ``name`` = sum of ``amount`` over the group up to and including the row.

    The rows are dealt out by ranges of (keys, order), so a group of any size lies in as many consecutive
    parts as it fills, whatever its times are; only rows equal in all of them stay together.  Rows are
    ordered inside their part and parts are linked by their totals, of which there is one per part and group in it.
    The parts are written once: their limits come from a sample, and both readers have to see the same ones.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialise(df.withColumn("_amount", amount).repartitionByRange(parts, *keys, *order)
                      .withColumn("_part", F.spark_partition_id()), "running-parts")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (cut.groupBy(*keys, "_part").agg(F.sum("_amount").alias("_part_total"))
               .withColumn("_offset", F.coalesce(F.sum("_part_total").over(before), F.lit(0)))
               .drop("_part_total"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    return (cut.join(offsets, [*keys, "_part"])
            .withColumn(name, F.col("_offset") + F.sum("_amount").over(inside))
            .drop("_part", "_amount", "_offset"))


def failure_runs(attempts: DataFrame, key: str, time: str, tie: str, failed: Column,
                 min_length: int = 5) -> DataFrame:
    """Unbroken runs of at least ``min_length`` failed attempts of one source.

    All failures of a run have the same number of successes before them, so counting
    successes cumulatively names the run and one aggregation finishes the work.
    """
    marked = attempts.select(key, time, tie, failed.alias("_failed")).dropna(subset=[key, time])
    counted = running_total(marked, [key], [time, tie], F.when(F.col("_failed"), 0).otherwise(1), "_successes")
    return (counted.where("_failed").groupBy(key, "_successes")
            .agg(F.count(F.lit(1)).alias("run_length"), F.min(time).alias("run_start"),
                 F.max(time).alias("run_end"))
            .where(F.col("run_length") >= min_length).drop("_successes"))
