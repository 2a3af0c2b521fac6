"""Stage tables: partitioned Parquet with whole-day replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table_exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A stage table; days in folder names come back as text, as dates are text throughout."""
    frame = spark.read.parquet(path)
    days = [name for name, kind in frame.dtypes if kind == "date"]
    return frame.withColumns({name: frame[name].cast("string") for name in days})


def write_stage(df: DataFrame, path: str, day: str | None = None, mode: str = "overwrite") -> None:
    """Write a stage table, split by ``day`` when named."""
    if day is None:
        df.write.mode(mode).parquet(path)
    else:
        df.write.mode(mode).partitionBy(day).parquet(path)
        spark = df.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"{day}=*")
        if not len(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(folder)):
            df.limit(0).write.mode("append").parquet(path)  # no day, so no file yet that has the columns


def replace_days(df: DataFrame, path: str, day: str, order: list[str] | None = None) -> None:
    """Replace exactly the days that occur in ``df``; the table's other days stay untouched.

    Running it again with the same rows leaves the table as it is.  Rows are sorted inside
    each file, which keeps files well compressed and their statistics selective.
    """
    rows = df.sortWithinPartitions(day, *(order or []))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(day).parquet(path))


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of the first partition column of a table, in order, read off its folder names."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(name.split("=", 1)[1] for name in names if name.startswith(f"{column}="))


def replace_partitions(df: DataFrame, path: str, columns: list[str], empty: list[str] | None = None) -> None:
    """Replace exactly the folders whose values occur in ``df``; those of ``empty`` (values of the first
    column) go.  One file a folder: rows of a folder meet before they are written."""
    spark = df.sparkSession
    (df.repartition(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*columns).parquet(path))
    for value in empty or []:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, f"{columns[0]}={value}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def append_csv(df: DataFrame, path: str) -> None:
    """Append rows as CSV that :func:`fareloom.sources.captures.csv_reader` reads back."""
    df.write.mode("append").options(header=True, quote='"', escape='"', quoteAll=True, emptyValue="").csv(path)
