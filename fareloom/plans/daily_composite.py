"""Direct-fare composite per day and booking horizon, with the agents' premium."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..operators.dedup import keep_latest
from ..operators.filters import agent_basket, direct_basket, in_agent_basket, in_direct_basket
from ..operators.order_stats import exact_median
from ..operators.outliers import IQR_KEYS, flag_iqr
from ..session import materialise
from .fare_index import weighted_fare

FLIGHT_KEYS = ["origin", "destination", "flight_num", "advance_purchase_days"]


def flagged_quotes(quotes: DataFrame, history_max: DataFrame | None = None,
                   day: str | None = "scraped_date", keep_sources: bool = False,
                   economy_only: bool = False, bounds_by_class: bool = False,
                   columns: list[str] | None = None) -> DataFrame:
    """Deduplicated quotes of each day with ``outlier_flag``.

    Days are worked on independently and all at once; ``day=None`` takes the table as one day.
    The newest rows are written once, as both the bounds and the flags read them; ``columns`` names those
    that the reader wants, where others only break ties.
    """
    by_day = [day] if day else []
    newest = keep_latest(quotes, keys=[*by_day, *C.DAILY_KEYS], keep_sources=keep_sources)
    rows = materialise(newest.select(*columns) if columns else newest, "newest")
    rows = rows.withColumn("fare_class", F.lower("fare_class"))
    if economy_only:
        rows = rows.where(F.col("fare_class") == "economy")
    keys = [*by_day, *IQR_KEYS, *(["fare_class"] if bounds_by_class else [])]
    return flag_iqr(rows, keys, history_max)


def flight_pairs(flagged: DataFrame, day: str | None = "scraped_date", few_quotes: bool = False) -> DataFrame:
    """Median agent and direct fare per flight and horizon, where both sides quote one.

    ``few_quotes`` is for keys that only a few quotes share, as one flight and horizon on one day: both
    medians then come from one aggregation.  Without it a key may hold any number of rows.
    """
    keys = [*([day] if day else []), *FLIGHT_KEYS]
    if few_quotes:
        fare = F.col("total_fare")
        medians = flagged.where(in_agent_basket() | in_direct_basket()).dropna(subset=keys).groupBy(*keys).agg(
            F.median(F.when(in_agent_basket(), fare)).alias("ota_fare"),
            F.median(F.when(in_direct_basket(), fare)).alias("dir_fare"))
        return medians.dropna(subset=["ota_fare", "dir_fare"])
    agent = exact_median(agent_basket(flagged), keys, "total_fare", "ota_fare")
    direct = exact_median(direct_basket(flagged), keys, "total_fare", "dir_fare")
    return agent.join(direct, keys)


def agent_premium(pairs: DataFrame, day: str | None = "scraped_date") -> DataFrame:
    """Mean premium in per cent per horizon; pairs with a fare that is not positive drop out."""
    keys = [*([day] if day else []), "advance_purchase_days"]
    usable = pairs.where((F.col("ota_fare") > 0) & (F.col("dir_fare") > 0))
    premium = 100 * (F.col("ota_fare") - F.col("dir_fare")) / F.col("dir_fare")
    return usable.groupBy(*keys).agg(F.avg(premium).alias("premium"))


def horizon_composite(flagged: DataFrame, weights: dict[str, float],
                      day: str | None = "scraped_date") -> DataFrame:
    """Weighted mean of route medians per horizon, weights renormalised over those present."""
    by_day = [day] if day else []
    medians = exact_median(direct_basket(flagged), [*by_day, *IQR_KEYS], "total_fare", "fare", rescan=True)
    route = S.route_name(F.col("origin"), F.col("destination"))
    wide = medians.groupBy(*by_day, "advance_purchase_days").agg(
        *[F.max(F.when(route == r, F.col("fare"))).alias(f"fare_{r}") for r in weights])
    fares = {r: F.col(f"`fare_{r}`") for r in weights}
    return (wide.select(*by_day, "advance_purchase_days",
                        weighted_fare(fares, weights).alias("composite"))
            .where(F.col("composite").isNotNull()))


def daily_composite(flagged: DataFrame, weights: dict[str, float] | None = None,
                    day: str = "scraped_date") -> DataFrame:
    """``date, advance_purchase_days, composite_score, ota_premium_pct``."""
    weights = C.WEIGHTS_V2 if weights is None else weights
    premium = agent_premium(flight_pairs(flagged, day, few_quotes=True), day)
    return (horizon_composite(flagged, weights, day)
            .join(premium, [day, "advance_purchase_days"], "left")
            .select(F.col(day).alias("date"), "advance_purchase_days",
                    S.rounded(F.col("composite"), 2).alias("composite_score"),
                    S.rounded(F.coalesce("premium", F.lit(0.0)), 2).alias("ota_premium_pct")))


def run_day(quotes: DataFrame, day: str, index_path: str, composite_path: str,
            weights: dict[str, float] | None = None, **options) -> None:
    """Index one day's quotes and replace that day in both tables."""
    from ..sources.tables import read_table, replace_days, table_exists
    from ..operators.outliers import history_maximum

    spark = quotes.sparkSession
    history = None
    if table_exists(spark, index_path):
        past = read_table(spark, index_path).where(F.col("scrape_date") != day)
        history = history_maximum(past)
    todays = quotes.where(S.text_date(F.col("scraped_at")) == day)
    if "scraped_ts" not in todays.columns:
        todays = todays.withColumn("scraped_ts", S.capture_instant(F.col("scraped_at")))
    flagged = (flagged_quotes(todays, history, day=None, **options)
               .withColumn("scrape_date", F.lit(day)))
    replace_days(flagged, index_path, "scrape_date",
                 order=["scraped_at", "origin", "destination", "advance_purchase_days"])
    stored = read_table(spark, index_path).where(F.col("scrape_date") == day)
    replace_days(daily_composite(stored, weights, day="scrape_date"), composite_path, "date",
                 order=["advance_purchase_days"])
