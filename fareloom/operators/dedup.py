"""Duplicate removal and append-if-new."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C


RUN_PART, RUN_PARTS = "run_part", 256


def with_run_part(quotes: DataFrame) -> DataFrame:
    """Add the partition value of a quote's run (a part of its ingest key)."""
    part = F.pmod(F.crc32(F.coalesce("capture_run", F.lit(""))), F.lit(RUN_PARTS)).cast("int")
    return quotes.withColumn(RUN_PART, part)


def _rank_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    # Spark ranks before the shuffle too (window group limit), so a crowd of copies of
    # one key shrinks to one row per task before any data moves.
    window = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_rank", F.row_number().over(window))
            .where(F.col("_rank") == 1).drop("_rank"))


def keep_latest(df: DataFrame, instant: str = "scraped_ts", keys: list[str] | None = None,
                keep_sources: bool = False) -> DataFrame:
    """Newest row per key; ties end the same way on every run.

    ``keep_sources`` adds the source to the key, so that an agent's quote does not replace
    the airline's own quote for the same seat.
    """
    keys = list(keys or C.DAILY_KEYS) + (["source"] if keep_sources else [])
    rest = [F.col(name).asc_nulls_last() for name, kind in df.dtypes
            if name not in keys and name != instant and not kind.startswith("map")]
    return _rank_one(df, keys, [F.col(instant).desc_nulls_last(), *rest])


def dedup_in_page(cards: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """One card per key: the first that parsed; when none parsed, the last one."""
    failed = F.col("status") == "parse_error"
    order = [failed.asc(), F.when(failed, -F.col(position)).otherwise(F.col(position)).asc()]
    return _rank_one(cards, keys, order)


def append_new(master: DataFrame, batch: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows of ``batch`` whose key is not in ``master`` yet; missing values match each other.

    Copies inside the batch itself all stay, as only the master is looked at.
    """
    keys = list(keys or C.INGEST_KEYS)
    seen = master.select(*[F.col(k).cast("string").alias(f"_seen_{k}") for k in keys])
    same = reduce(lambda a, b: a & b,
                  [batch[k].cast("string").eqNullSafe(seen[f"_seen_{k}"]) for k in keys])
    return batch.join(seen, same, "left_anti")


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
