"""Directory of capture runs: which folders of the master quote table hold rows of a run.

The run is part of the ingest key, so only folders listed for a batch's runs can hold its keys.  The
directory has a row per (run, capture date), stands beside the master as ``<master>_runs`` and is written
before the master's rows: a job that dies in between leaves a row too many, never one too few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import RUN_PART
from .tables import read_table, table_exists

DAY = "scraped_date"
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"  # Spark's folder name for a missing value


def run_days(quotes: DataFrame) -> DataFrame:
    """Distinct ``run_part, run, scraped_date``; a missing run counts as an empty name."""
    return quotes.select(RUN_PART, F.coalesce(F.col("capture_run").cast("string"), F.lit("")).alias("run"),
                         F.coalesce(F.col(DAY).cast("string"), F.lit(_NO_DAY)).alias(DAY)).distinct()


def directory(spark: SparkSession, master: str) -> DataFrame | None:
    """The directory of a master table, built once where the table is older; None without a table."""
    if not table_exists(spark, master):
        return None
    if not table_exists(spark, f"{master}_runs"):
        run_days(read_table(spark, master)).write.mode("overwrite").parquet(f"{master}_runs")
    return spark.read.schema(f"{RUN_PART} int, run string, {DAY} string").parquet(f"{master}_runs")


def rows_of_runs(batch: DataFrame, master: str) -> DataFrame | None:
    """The master's folders that hold runs of ``batch``; None where there are none.

    What reaches the driver are names of folders, as in the file index of any scan of the table.
    """
    spark = batch.sparkSession
    known = directory(spark, master)
    if known is None:
        return None
    met = known.join(run_days(batch).select(RUN_PART, "run").distinct(), [RUN_PART, "run"], "left_semi")
    folders = [f"{master}/{RUN_PART}={part}/{DAY}={day}" for part, day in met.select(RUN_PART, DAY).distinct().collect()]
    folders = [path for path in folders if table_exists(spark, path)]  # a job may have died before it wrote the rows
    return spark.read.option("basePath", master).parquet(*folders) if folders else None


def append_rows(fresh: DataFrame, master: str) -> None:
    """List the runs of ``fresh`` and append its rows to the master."""
    known = directory(fresh.sparkSession, master)
    new = run_days(fresh)
    if known is not None:
        new = new.join(known, new.columns, "left_anti")
    new.write.mode("append").parquet(f"{master}_runs")
    fresh.write.mode("append").partitionBy(RUN_PART, DAY).parquet(master)
