"""Daily fare index: medians per horizon, route fares, weighted composite, base 100."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..operators.filters import excluded_audit, index_eligible
from ..operators.order_stats import exact_median


def horizon_medians(eligible: DataFrame) -> DataFrame:
    """Median fare per (date, route, horizon)."""
    keys = ["scraped_date", "route", "advance_purchase_days"]
    return exact_median(eligible, keys, "total_fare", "fare", rescan=True)


def route_days(medians: DataFrame) -> DataFrame:
    """Route fare of a day: the mean of its horizon medians, with the number of horizons.

    The handful of medians is added up in sorted order, so that a rerun gives the same last
    digit whatever order the tasks finished in.
    """
    total = F.aggregate(F.array_sort(F.collect_list("fare")), F.lit(0.0), lambda a, x: a + x)
    return medians.groupBy("scraped_date", "route").agg(
        (total / F.count(F.lit(1))).alias("fare"), F.count(F.lit(1)).alias("n_horizons"))


def weighted_fare(fares: dict[str, Column], weights: dict[str, float] | None) -> Column:
    """Weighted mean of the routes that have a fare, always added up in the same order.

    Equal weights apply when none are given or those of the reporting routes sum to zero.
    """
    def total(terms) -> Column:
        return reduce(lambda a, b: a + b, terms)

    def mean(weight_of) -> Column:
        above = total(F.coalesce(fare * weight_of(r), F.lit(0.0)) for r, fare in fares.items())
        below = total(F.when(fare.isNotNull(), F.lit(weight_of(r))).otherwise(F.lit(0.0))
                      for r, fare in fares.items())
        return above / F.when(below > 0, below)

    return F.coalesce(mean(lambda r: float((weights or {}).get(r, 0.0))), mean(lambda r: 1.0))


def day_summary(route_fares: DataFrame, weights: dict[str, float] | None, basket: list[str],
                expected: int | None = None, basket_completeness: bool = False) -> DataFrame:
    """One row per date: composite fare, completeness and ``fare_<route>`` columns.

    The composite is the weighted mean over the basket routes that report on the date, to
    two decimals.  Completeness is the share of the expected (route, horizon) combinations;
    routes outside the basket count too, so it can pass 1, unless ``basket_completeness``.
    """
    in_basket = F.col("route").isin(basket)
    counted = F.when(in_basket, F.col("n_horizons")) if basket_completeness else F.col("n_horizons")
    expected = expected or len(basket) * len(C.HORIZONS)
    wide = route_fares.groupBy("scraped_date").agg(
        S.rounded(F.coalesce(F.sum(counted), F.lit(0)) / F.lit(float(expected)), 4)
        .alias("data_completeness"),
        *[F.max(F.when(F.col("route") == r, F.col("fare"))).alias(f"fare_{r}") for r in basket])
    fares = {r: F.col(f"`fare_{r}`") for r in basket}
    return wide.withColumn("composite_daily_fare", S.rounded(weighted_fare(fares, weights), 2))


def _base_value(value: str, date: str, base_date: str | None):
    """Value on the base date (the first date by default) of a table with a row per date."""
    days = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if base_date is None:
        return F.first(F.col(f"`{value}`")).over(days)
    return F.max(F.when(F.col(date) == base_date, F.col(f"`{value}`"))).over(days)


def rebased(daily: DataFrame, value: str, name: str, base_date: str | None = None,
            date: str = "date") -> DataFrame:
    """Add ``name`` = value / base-day value * 100; 100 where the base is missing or <= 0.

    Only for tables with one row per date: ordering them by date is a matter of a few
    hundred rows per year.
    """
    base = _base_value(value, date, base_date)
    ratio = S.rounded(F.col(value) / F.when(base > 0, base) * 100, 2)
    return daily.withColumn(name, F.when(base > 0, ratio).otherwise(F.lit(100.0)))


def route_index(route_fares: DataFrame, base_date: str | None = None) -> DataFrame:
    """``scraped_date, route, fare, index`` against the route's fare on the base date.

    The base date is the first date of the table; routes silent on it have no index.
    """
    base = F.lit(base_date) if base_date else route_fares.select(F.min("scraped_date")).scalar()
    at_base = (route_fares.where(F.col("scraped_date") == base)
               .select("route", F.col("fare").alias("base_fare")))
    ratio = F.col("fare") / F.when(F.col("base_fare") != 0, F.col("base_fare")) * 100
    return (route_fares.join(at_base, "route", "left")
            .select("scraped_date", "route", "fare", ratio.alias("index")))


def widen(route_values: DataFrame, basket: list[str]) -> DataFrame:
    """One row per date with ``index_<route>`` and ``fare_<route>`` columns."""
    return (route_values.where(F.col("route").isin(basket)).groupBy("scraped_date")
            .pivot("route", basket)
            .agg(S.rounded(F.max("index"), 2).alias("index"), S.rounded(F.max("fare"), 2).alias("fare"))
            .select("scraped_date", *[F.col(f"`{r}_{kind}`").alias(f"{kind}_{r}")
                                      for r in basket for kind in ("index", "fare")]))


def lengthen(index: DataFrame, basket: list[str], kind: str = "fare") -> DataFrame:
    """Back from per-route columns to ``date, route, <kind>``."""
    columns = [f"{kind}_{r}" for r in basket]
    return (index.select("date", *[F.col(f"`{c}`").alias(r) for c, r in zip(columns, basket)])
            .unpivot("date", [F.col(f"`{r}`") for r in basket], "route", kind))


def fare_index_daily(quotes: DataFrame, weights: dict[str, float] | None = None,
                     basket: list[str] | None = None, base_date: str | None = None,
                     basket_completeness: bool = False) -> DataFrame:
    """The published daily table: composite, completeness and per-route columns.

    Two aggregations bring the medians down to one row per date; the base-day values are
    read off those rows.  A route that is silent on the base date has no index.
    """
    weights = C.WEIGHTS_V1 if weights is None else weights
    basket = basket or C.BASKET
    fares = route_days(horizon_medians(index_eligible(quotes)))
    days = (day_summary(fares, weights, basket, basket_completeness=basket_completeness)
            .withColumnRenamed("scraped_date", "date"))
    days = rebased(days, "composite_daily_fare", "composite_fare_index", base_date)
    columns = []
    for route in basket:
        fare, base = F.col(f"`fare_{route}`"), _base_value(f"fare_{route}", "date", base_date)
        columns += [S.rounded(fare / F.when(base != 0, base) * 100, 2).alias(f"index_{route}"),
                    S.rounded(fare, 2).alias(f"fare_{route}")]
    return days.select("date", "composite_fare_index", "composite_daily_fare",
                       "data_completeness", *columns)


def excluded_fares(quotes: DataFrame) -> DataFrame:
    """Audit of the rows that did not enter the index."""
    return excluded_audit(quotes)


def headline_change(daily: DataFrame, value: str = "composite_fare_index") -> DataFrame:
    """Change in points against the previous available date (one row per date)."""
    # one row per calendar day: the window holds a few hundred rows per year
    previous = F.lag(value).over(Window.orderBy("date"))
    return daily.select("date", value, S.rounded(F.col(value) - previous, 1).alias("change"))
