"""Small helpers that several operators of this folder use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows per Arrow batch: a batch of long texts has to fit a Python worker.
BATCH_ROWS = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, in Arrow batches of a bounded number of rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def filter_batches(df: DataFrame, keep: Callable[[pa.RecordBatch], list], helper: str | None = None) -> DataFrame:
    """The rows of ``df`` for which ``keep`` holds, with all columns but ``helper``, where they lie."""
    kept = df.drop(helper) if helper else df
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(names).filter(pa.array(keep(batch), pa.bool_()))

    return df.mapInArrow(run, kept.schema)


def over_batches(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """``work`` turns each Arrow batch into columns (name to list or array) of ``schema``."""
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = work(batch)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type)
                 for f in arrow], arrow.names)

    return df.mapInArrow(run, schema)


def ascii_lower(column):
    """A-Z to lower case and nothing else; null becomes the empty text."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: The same for Python text.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)
