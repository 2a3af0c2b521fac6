"""Confidence scores: provenance rules, stale selectors and cross-source confirmation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..session import materialise
from .filters import crosscheck_candidates

CONFIRM_KEYS = ["flight_num", "travel_date", "scraped_date"]
CELL_STEPS = 16


def confirmed_keys(quotes: DataFrame, tolerance: float = C.CROSS_SOURCE_TOLERANCE,
                   keys: list[str] | None = None) -> DataFrame:
    """Keys for which two sources quote fares within ``tolerance`` of each other.

    Fares are put on a logarithmic grid whose step is the tolerance; a cell holds ``CELL_STEPS``
    steps.  A fare on the last step of its cell is entered in the next one as well, so any
    agreeing pair shares a cell and few fares are entered twice.  Inside a cell
    the closest pair from different sources is adjacent in fare order, which one ``lag``
    finds; equal offers stand beside each other and change nothing.  No pairs are built, and a key
    with very many quotes is spread over its cells.
    """
    keys = list(keys or CONFIRM_KEYS)
    offers = (crosscheck_candidates(quotes).where(F.col("total_fare") > 0)
              .dropna(subset=[*keys, "source_scraper"])
              .select(*keys, "source_scraper", "total_fare"))
    step = -math.log1p(-tolerance) * 1.001
    place = F.floor(F.log("total_fare") / step)
    cells = F.array_distinct(F.array(F.floor(place / CELL_STEPS), F.floor((place + 1) / CELL_STEPS)))
    placed = offers.withColumn("_cell", F.explode(cells))
    order = Window.partitionBy(*keys, "_cell").orderBy("total_fare", "source_scraper")
    gap = (F.col("total_fare") - F.col("_fare")) / F.col("total_fare")
    return (placed
            .withColumn("_fare", F.lag("total_fare").over(order))
            .withColumn("_source", F.lag("source_scraper").over(order))
            .where((F.col("_source") != F.col("source_scraper")) & (gap <= tolerance))
            .select(*keys).distinct())


def mark_confirmed(quotes: DataFrame, **options) -> DataFrame:
    """Add ``cross_source_confirmed`` to every row, whatever its status.

    The keys are written out first: where they are few, the rows are not shuffled to meet them.
    """
    keys = list(options.get("keys") or CONFIRM_KEYS)
    found = materialise(confirmed_keys(quotes, **options), "confirmed").withColumn("_confirmed", F.lit(True))
    return (quotes.join(found, keys, "left")
            .withColumn("cross_source_confirmed", F.coalesce("_confirmed", F.lit(False)))
            .drop("_confirmed"))


def oldest_verified(selectors: DataFrame) -> DataFrame:
    """Oldest verification per site of the active selectors; local times are +05:30."""
    text = F.col("last_verified_at")
    zoned = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(
        F.concat(text, F.lit("+05:30")))
    return (selectors.where("active").groupBy("site")
            .agg(F.min(zoned.try_cast("timestamp")).alias("oldest_verified_at")))


def stale_sources(verified: DataFrame, now: str, known: list[str] | None = None,
                  stale_days: int = C.STALE_DAYS) -> DataFrame:
    """``source_scraper, is_stale`` for every known source; no registry counts as stale."""
    spark = verified.sparkSession
    names = ", ".join(f"'{name}'" for name in (known or C.KNOWN_SCRAPERS))
    sources = spark.sql(f"SELECT explode(array({names})) AS source_scraper")
    seconds = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(
        "oldest_verified_at")
    age = F.floor(seconds / 86400)
    return (sources.join(verified.withColumnRenamed("site", "source_scraper"),
                         "source_scraper", "left")
            .select("source_scraper",
                    F.coalesce(age > stale_days, F.lit(True)).alias("is_stale")))


def _rules(stale: Column, confirmed: Column) -> list[tuple[Column, str, float]]:
    priced_ok_missing = F.col("status").eqNullSafe("ok") & F.col("total_fare").isNull()
    return [
        (F.col("data_source_method").eqNullSafe("llm_fallback"), "llm_sourced",
         -C.PENALTY_MODEL_SOURCED),
        (F.coalesce("fare_split_estimated", F.lit(False)), "fare_estimated",
         -C.PENALTY_ESTIMATED),
        (priced_ok_missing, "missing_price", -C.PENALTY_MISSING_PRICE),
        (stale, "stale_selector", -C.PENALTY_STALE),
        (confirmed, "cross_source_confirmed", C.BONUS_CONFIRMED),
    ]


def quality_scores(quotes: DataFrame, stale: DataFrame | None = None,
                   tolerance: float = C.CROSS_SOURCE_TOLERANCE) -> DataFrame:
    """Add ``confidence_score`` (0..1) and ``quality_flags`` in rule order.

    ``stale`` comes from :func:`stale_sources`; sources it does not list are never stale.
    """
    rows = mark_confirmed(quotes, tolerance=tolerance)
    if stale is None:
        rows = rows.withColumn("is_stale", F.lit(False))
    else:
        rows = rows.join(materialise(stale, "stale"), "source_scraper", "left")  # a row per source: no shuffle by source
    rules = _rules(F.coalesce("is_stale", F.lit(False)), F.col("cross_source_confirmed"))
    score = F.lit(1.0)
    for holds, _, change in rules:
        moved = score + change
        score = F.when(holds, F.least(F.lit(1.0), moved) if change > 0 else moved).otherwise(score)
    flags = F.array_compact(F.array(*[F.when(holds, F.lit(name)) for holds, name, _ in rules]))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return (rows.withColumn("confidence_score", S.rounded(clamped, 4))
            .withColumn("quality_flags", flags).drop("is_stale", "cross_source_confirmed"))


def flag_counts(flagged: DataFrame) -> DataFrame:
    return (flagged.select(F.explode("quality_flags").alias("flag")).groupBy("flag")
            .agg(F.count(F.lit(1)).alias("n_rows")))


def score_summary(flagged: DataFrame) -> DataFrame:
    """Mean, minimum, perfect rows and flagged rows of a scored table."""
    score = F.col("confidence_score")
    return flagged.agg(F.count(F.lit(1)).alias("n_rows"),
                       S.rounded(F.avg(score), 4).alias("mean_confidence"),
                       F.min(score).alias("min_confidence"),
                       F.count_if(score == 1.0).alias("perfect_rows"),
                       F.count_if(F.size("quality_flags") > 0).alias("flagged_rows"))
