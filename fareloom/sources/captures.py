"""Raw capture files: CSV drops, saved pages, and files that cannot be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..schema import RAW_COLUMNS, RAW_QUOTES


#: standard quoting: quotes are doubled inside quotes, and a quoted field may span lines
CSV_QUOTING = {"header": True, "quote": '"', "escape": '"', "multiLine": True}
FILES = {"recursiveFileLookup": True, "pathGlobFilter": "*.csv"}


def with_origin(frame: DataFrame, path) -> DataFrame:
    """Add source file and scraper; words that mean "missing" in a CSV become null."""
    cells = {name: F.when(~F.col(name).isin(C.CSV_MISSING_TOKENS), F.col(name))
             for name in RAW_COLUMNS}
    return (frame.withColumns(cells).withColumn("source_file", path)
            .withColumn("source_scraper", S.scraper_from_path(F.col("source_file"))))


def csv_reader(reader):
    """A batch or stream reader for capture files: all text, standard quoting.

    Files with the older, shorter header are read by the same layout: its columns are the
    first ones of the newer header.
    """
    return (reader.schema(RAW_QUOTES).options(**CSV_QUOTING, **FILES)
            .option("enforceSchema", True).option("mode", "PERMISSIVE"))


def read_raw_quotes(spark: SparkSession, root: str, day: str | None = None,
                    modified_after: str | None = None) -> DataFrame:
    """All capture CSVs below ``root`` (or of one day's folder), every column as text.

    ``modified_after`` leaves out files that were last written before that time.  Unreadable files are
    skipped; :func:`file_rejects` names them.
    """
    reader = csv_reader(spark.read).option("ignoreCorruptFiles", True)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    frame = reader.csv(f"{root.rstrip('/')}/{day}" if day else root)
    return with_origin(frame, F.col("_metadata.file_path"))


def list_files(spark: SparkSession, root: str, modified_after: str | None = None) -> DataFrame:
    """``source_file`` of all capture files below ``root``, empty ones too; nothing is opened.

    Scans leave empty files out, so the names come from the file index that the driver builds for
    any scan of the folder.
    """
    reader = spark.read.schema("value string").options(**FILES)
    index = (reader.option("modifiedAfter", modified_after) if modified_after else reader).text(root)
    return spark.createDataFrame([(path,) for path in index.inputFiles()], "source_file string")


def text_lines(reader):
    """A reader of lines that end at a line feed only; large files are read in parts, what cannot be read is skipped."""
    return reader.option("lineSep", "\n").option("ignoreCorruptFiles", True)


def file_rejects(spark: SparkSession, root: str, modified_after: str | None = None) -> DataFrame:
    """Rejects ``(source_file, error, raw_row)`` of whole files: empty ones, and ones whose bytes
    cannot all be read.

    The bytes of a file's lines are held against its length, so no task holds a file.  The line reader takes
    a byte order mark (3 bytes) off the head of a text, and a last line may lack its line break: a file that
    misses two or three bytes is a whole one.  A file that holds a header and no rows is a good, empty file.
    """
    def files(kind: str):
        reader = spark.read.format(kind).options(**FILES)
        return reader.option("modifiedAfter", modified_after) if modified_after else reader

    key = S.file_key(F.col("source_file"))
    sizes = files("binaryFile").load(root).select(S.file_key(F.col("path")).alias("_key"), "length")
    seen = (text_lines(files("text")).load(root)
            .groupBy(S.file_key(F.col("_metadata.file_path")).alias("_key"))
            .agg(F.sum(F.octet_length("value") + 1).alias("bytes")))
    missing = F.col("length") - F.coalesce("bytes", F.lit(0))
    half_read = (sizes.join(seen, "_key", "left")
                 .where(F.col("bytes").isNull() | (missing > 0) & ~missing.isin(2, 3)).select("_key"))
    names = list_files(spark, root, modified_after).withColumn("_key", key)
    empty = names.join(sizes, "_key", "left_anti")  # an empty file is in no scan
    return (names.join(half_read, "_key", "left_semi").unionByName(empty)
            .select("source_file", F.lit("CSV read error").alias("error"), F.lit("FILE_LEVEL").alias("raw_row")))


def without_rejected_files(quotes: DataFrame, rejects: DataFrame) -> DataFrame:
    """Rows of files that were read whole: a half-read file is a reject as a whole."""
    names = rejects.select(S.file_key(F.col("source_file")).alias("_key"))
    return quotes.join(names, S.file_key(F.col("source_file")) == F.col("_key"), "left_anti")


def read_pages(spark: SparkSession, root: str, glob: str = "*.html") -> DataFrame:
    """Saved pages, one row per file: ``page_path, html``."""
    return (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
            .text(root, wholetext=True)
            .select(F.col("_metadata.file_path").alias("page_path"), F.col("value").alias("html")))
