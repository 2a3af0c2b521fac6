"""Row filters and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def _is_ok() -> Column:
    return F.col("status").eqNullSafe("ok")


def _is_flagged() -> Column:
    return F.coalesce(F.array_contains("quality_flags", C.FLAG_STATISTICAL), F.lit(False))


def index_eligible(quotes: DataFrame) -> DataFrame:
    """Priced ok quotes that are no statistical anomaly."""
    return quotes.where(_is_ok() & ~_is_flagged() & F.col("total_fare").isNotNull())


def excluded_audit(quotes: DataFrame) -> DataFrame:
    """The other rows, each with its reasons in ``exclusion_reason``."""
    no_fare = F.col("total_fare").isNull()
    status_text = F.concat(F.lit("status_not_ok ("), F.coalesce("status", F.lit("nan")),
                           F.lit(")"))
    reasons = F.array_compact(F.array(
        F.when(~_is_ok(), status_text),
        F.when(_is_flagged(), F.lit(C.FLAG_STATISTICAL)),
        F.when(no_fare, F.lit("null_total_fare"))))
    reason = F.when(F.size(reasons) > 0, F.concat_ws("; ", reasons)).otherwise(
        F.lit("filtered_other"))
    return (quotes.where(~_is_ok() | _is_flagged() | no_fare)
            .withColumn("exclusion_reason", reason))


def in_direct_basket() -> Column:
    return (_is_ok() & (F.col("source") == "airline_direct") & ~F.col("outlier_flag")
            & ~F.col("carrier_name").eqNullSafe(C.EXCLUDED_CARRIER))


def in_agent_basket() -> Column:
    return _is_ok() & (F.col("source") == "ota") & ~F.col("outlier_flag")


def direct_basket(flagged: DataFrame) -> DataFrame:
    """Airline quotes that enter the daily index."""
    return flagged.where(in_direct_basket())


def agent_basket(flagged: DataFrame) -> DataFrame:
    """Agent quotes that enter the premium."""
    return flagged.where(in_agent_basket())


def crosscheck_candidates(quotes: DataFrame) -> DataFrame:
    return quotes.where(_is_ok() & F.col("total_fare").isNotNull()
                        & ~F.col("flight_num").isin("unknown", "error"))


def last_hours(quotes: DataFrame, hours: int = 24, instant: str = "scraped_ts") -> DataFrame:
    """Rows of the last hours before the newest capture."""
    newest = quotes.select(F.max(instant)).scalar()
    return quotes.where(F.col(instant) >= newest - F.make_dt_interval(hours=F.lit(hours)))


def latest_date_rows(quotes: DataFrame, date: str = "scraped_date") -> DataFrame:
    return quotes.where(F.col(date) == quotes.select(F.max(date)).scalar())


def with_flag(quotes: DataFrame, flag: str | None = None) -> DataFrame:
    """Rows carrying ``flag``, or any flag when none is named."""
    keep = F.array_contains("quality_flags", flag) if flag else F.size("quality_flags") > 0
    return quotes.where(keep)


def min_confidence(quotes: DataFrame, threshold: float) -> DataFrame:
    return quotes.where(F.col("confidence_score") >= threshold)


def by_route_and_carrier(quotes: DataFrame, route: str | None = None,
                         carrier: str | None = None) -> DataFrame:
    if route:
        origin, destination = route.split("-", 1)
        quotes = quotes.where((F.col("origin") == origin)
                              & (F.col("destination") == destination))
    if carrier and carrier != "All":
        quotes = quotes.where(F.col("carrier_name") == carrier)
    return quotes


def split_alternate_airports(cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, audit): cards for the airports asked for, and counts of the others.

    Needs ``origin, destination`` (asked for) and ``actual_origin, actual_destination``
    (on the card; null means not shown, which is no mismatch).
    """
    asked = F.concat_ws("-", "origin", "destination")
    actual = F.concat_ws("-", F.coalesce("actual_origin", "origin"),
                         F.coalesce("actual_destination", "destination"))
    marked = cards.withColumn("actual_route", actual)
    audit = (marked.where(actual != asked).groupBy("source_name", "actual_route")
             .agg(F.count(F.lit(1)).alias("discarded")))
    return marked.where(actual == asked).drop("actual_route"), audit


def non_stop_only(cards: DataFrame, text: str = "card_text") -> DataFrame:
    return cards.where(F.col(text).contains("Non-stop"))


def plausible_direct(fare: Column) -> Column:
    """Whole rupees inside the range an airline page can show."""
    return (fare == F.floor(fare)) & fare.between(*C.DIRECT_FARE_RANGE)


def agent_status(fare: Column, flight: Column) -> Column:
    good = (fare > C.AGENT_FARE_MIN) & (F.length(flight) > 0)
    return F.when(good, F.lit("ok")).otherwise(F.lit("parse_error"))
