"""Continuous ingest of capture files, batch by batch as the daily run does it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.normalize import normalize, rejected_rows, valid_quotes, with_derived
from ..plans.daily_run import append_to_master
from ..session import materialise, prepare
from ..sources.captures import csv_reader, with_origin
from ..sources.tables import replace_days


def stream_quotes(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """Normalised rows, valid or not, from a growing folder; nothing is dropped by age."""
    prepare(spark)
    raw = csv_reader(spark.readStream).option("maxFilesPerTrigger", files_per_batch).csv(root)
    return normalize(with_origin(raw, F.col("_metadata.file_path")))


def append_quotes(checked: DataFrame, store: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each batch adds its new valid quotes to the master table and its rejects to the reject table.

    Quotes whose key the master has already stay out, so a batch that is played again adds nothing (only folders of its runs are read), and
    copies inside one batch all stay, as in a daily run.  Rejects lie in one folder per batch, which a
    batch that is played again replaces.
    """
    def add(batch: DataFrame, number: int) -> None:
        rows = materialise(batch, "stream-batch")  # used for quotes and rejects
        append_to_master(with_derived(valid_quotes(rows)), f"{store}/quotes")
        replace_days(rejected_rows(rows).withColumn("batch", F.lit(number)), f"{store}/stream_rejects", "batch")

    writer = checked.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
