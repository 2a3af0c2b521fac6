"""Session settings shared by jobs and tests."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "fareloom", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with UTC dates and adaptive execution; cluster settings stay untouched."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        # one local JVM does all the work; its default heap of 1 GB is meant for a driver only
        builder = (builder.master(master)
                   .config("spark.driver.memory", "12g")
                   .config("spark.ui.enabled", "false")
                   .config("spark.driver.host", "127.0.0.1")
                   .config("spark.driver.bindAddress", "127.0.0.1"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Calendar dates are UTC dates throughout, so the session zone has to be UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that the driver and all executors reach, named in ``spark.checkpoint.dir``.

    Where that is unset, as in tests, work goes below the warehouse, which is shared as well.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_work")


def run_folder(spark: SparkSession) -> str:
    """One folder per application, so that a job's leftovers go as a whole."""
    return os.path.join(shared_folder(spark), f"fareloom-{spark.sparkContext.applicationId}")


def drop_work(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder, at the end of a job."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, label: str, **options) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used where a result feeds several later jobs: lineage ends at files that survive the
    loss of executors, and every reader prunes columns on its own.
    ``options`` are those of the Parquet writer.
    """
    spark = df.sparkSession
    path = os.path.join(run_folder(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

