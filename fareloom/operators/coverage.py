"""Collection coverage: finished horizons, gaps and failed runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def completed_horizons(captures: DataFrame, min_routes: int = C.COVERAGE_MIN_ROUTES,
                       status: str = "raw_status", ignored: list[str] | None = None,
                       by: list[str] | None = None) -> DataFrame:
    """Horizons for which one file of a source covers enough distinct routes."""
    by = list(by or [])
    keys = [*by, "source_scraper", "advance_purchase_days"]
    counted = (captures.where(~F.col(status).isin(ignored or C.COVERAGE_IGNORED)
                              | F.col(status).isNull())
               .groupBy(*keys, "source_file")
               .agg(F.countDistinct("route").alias("n_routes")))
    return counted.where(F.col("n_routes") >= min_routes).select(*keys).distinct()


def coverage_gaps(captures: DataFrame, horizons: list[int] | None = None,
                  by: list[str] | None = None, **options) -> DataFrame:
    """Required horizons that a source has not finished (per day when ``by`` names it)."""
    by = list(by or [])
    wanted = F.explode(F.array(*[F.lit(h) for h in (horizons or C.HORIZONS)]))
    required = (captures.select(*by, "source_scraper").distinct()
                .withColumn("advance_purchase_days", wanted))
    done = completed_horizons(captures, by=by, **options)
    return required.join(done, [*by, "source_scraper", "advance_purchase_days"], "left_anti")


def failed_sources(captures: DataFrame) -> DataFrame:
    """Per source the newest file, and whether it holds no usable quote."""
    files = captures.groupBy("source_scraper", "source_file").agg(
        F.max("scraped_ts").alias("file_time"),
        F.count_if(F.col("status") == "ok").alias("ok_rows"))
    newest = F.max_by(F.struct("source_file", "ok_rows"), F.struct("file_time", "source_file"))
    return (files.groupBy("source_scraper").agg(newest.alias("_f"))
            .select("source_scraper", F.col("_f.source_file").alias("source_file"),
                    F.col("_f.ok_rows").alias("ok_rows"),
                    (F.col("_f.ok_rows") == 0).alias("failed")))
