"""Analyst queries over the quote, index and forecast tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..operators import filters
from ..operators.order_stats import UPPER_MIDDLE, exact_median, exact_order_stats
from ..sources.weights import route_weights


def _percent(part: Column, whole: Column) -> Column:
    return 100 * part / F.when(whole != 0, whole)


def accepted(flagged: DataFrame) -> DataFrame:
    """Ok quotes that are no outlier."""
    return flagged.where((F.col("status") == "ok") & ~F.col("outlier_flag"))


# --- index tables -------------------------------------------------------------------

def index_latest(index: DataFrame) -> DataFrame:
    """The newest record with the number of days collected."""
    row = F.max_by(F.struct("*"), "date").alias("_row")
    return (index.agg(row, F.count(F.lit(1)).alias("total_days_collected"))
            .select("_row.*", "total_days_collected"))


def index_history(index: DataFrame, route: str | None = None, days: int = 30) -> DataFrame:
    """The trailing ``days`` records, for one route or with all route columns."""
    if days < 1:
        raise ValueError("days must be at least 1")
    trailing = index.orderBy(F.desc("date")).limit(days)
    if route is None:
        return trailing
    name = route.strip().upper()
    shown = ["date", "composite_fare_index", "composite_daily_fare", "data_completeness"]
    pair = [F.col(f"`{kind}_{name}`") if f"{kind}_{name}" in index.columns
            else F.lit(None).cast("double").alias(f"{kind}_{name}") for kind in ("index", "fare")]
    return trailing.select(*shown, F.lit(name).alias("route"), *pair)


def forecast_for(forecast: DataFrame, route: str | None = None) -> DataFrame:
    """Forecast rows of one target; a bare route means its index."""
    if route is None:
        return forecast
    target = route if route.startswith("index_") or route == "composite_fare_index" else (
        f"index_{route.upper()}")
    return forecast.where(F.col("target") == target)


def daily_headline(composite: DataFrame) -> DataFrame:
    """Latest index value against the first date, from ``date, ..., composite_score``."""
    by_day = composite.groupBy("date").agg(
        F.avg("composite_score").alias("score"), F.count(F.lit(1)).alias("advance_windows"),
        F.avg("ota_premium_pct").alias("premium"))
    at_end = F.max_by(F.struct("score", "advance_windows", "premium"), "date")
    ends = by_day.agg(F.max("date").alias("date"), at_end.alias("now"),
                      F.min_by("score", "date").alias("base"),
                      F.count(F.lit(1)).alias("days_live"))
    base = F.when(F.col("base") == 0, F.lit(1.0)).otherwise(F.col("base"))
    return ends.select("date", S.rounded(F.col("now.score") / base * 100, 1).alias("value"),
                       "days_live", F.col("now.advance_windows").alias("advance_windows"),
                       S.rounded(F.col("now.premium"), 2).alias("ota_premium_pct"))


# --- quotes -------------------------------------------------------------------------

def quality_flags(flagged: DataFrame, order: list[str], min_confidence: float | None = None,
                  flag: str | None = None, limit: int = 100) -> DataFrame:
    """The first ``limit`` flagged records in the given total order."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    rows = filters.with_flag(flagged, flag)
    if min_confidence is not None:
        rows = filters.min_confidence(rows, min_confidence)
    return rows.orderBy(*order).limit(limit)


def fares_recent(quotes: DataFrame, hours: int = 24) -> DataFrame:
    """Quotes of the last hours before the newest one, newest first."""
    return filters.last_hours(quotes, hours).orderBy(F.desc("scraped_ts"))


def fares_of_latest_date(quotes: DataFrame, date: str = "scraped_date") -> DataFrame:
    return filters.latest_date_rows(quotes, date).orderBy(F.desc("scraped_at"))


def sorted_by(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Sort by any column: text without regard to case, missing values last both ways."""
    key = F.lower(column) if dict(df.dtypes)[column] == "string" else F.col(column)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last())


def route_trend(quotes: DataFrame) -> DataFrame:
    """Median fare per route and date (any status, all horizons), first date = 100."""
    daily = exact_median(quotes, ["route", "scraped_date"], "total_fare", "fare", rescan=True)
    first = F.first("fare").over(Window.partitionBy("route").orderBy("scraped_date"))
    base = F.when(first == 0, F.lit(1.0)).otherwise(first)
    return daily.select("route", F.col("scraped_date").alias("date"),
                        S.rounded(F.col("fare") / base * 100, 1).alias("value"))


def rebased_route_fares(index_long: DataFrame, days: int | None = None) -> DataFrame:
    """Route fares of a history slice (``date, route, fare``), first record = 100."""
    if days is not None:
        dates = index_long.select("date").distinct().orderBy(F.desc("date")).limit(days)
        index_long = index_long.join(dates, "date", "left_semi")
    base = F.first("fare").over(Window.partitionBy("route").orderBy("date"))
    value = F.when(base != 0, S.rounded(F.coalesce("fare", F.lit(0.0)) / base * 100, 1)).otherwise(
        F.lit(100.0))
    return index_long.select("date", "route", value.alias("value"))


def route_heatmap(flagged: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Change per route on the latest date against the previous date that has quotes."""
    good = accepted(flagged)
    # two rows, from dates made distinct before the shuffle
    newest = good.select("scraped_date").where("scraped_date is not null").distinct().orderBy(F.desc("scraped_date")).limit(2)
    marked = newest.withColumn("is_last", F.row_number().over(Window.orderBy(F.desc("scraped_date"))) == 1)
    recent = good.join(F.broadcast(marked), "scraped_date")
    fares = exact_median(recent, ["route", "is_last"], "total_fare", "fare", rescan=True)
    is_last = F.col("is_last")
    pair = (fares.groupBy("route")
            .agg(F.max(F.when(is_last, F.col("fare"))).alias("current_fare"),
                 F.max(F.when(~is_last, F.col("fare"))).alias("previous_fare"))
            .where(F.col("current_fare").isNotNull()))
    before = F.coalesce("previous_fare", "current_fare")
    change = F.coalesce(_percent(F.col("current_fare") - before, before), F.lit(0.0))
    table = route_weights(flagged.sparkSession, weights or C.WEIGHTS_V2)
    return (pair.join(table, "route", "left")
            .select("route", S.rounded(change, 2).alias("pct_change"), "current_fare",
                    F.coalesce("weight", F.lit(0.0)).alias("weight")))


def index_heatmap(index_long: DataFrame) -> DataFrame:
    """The same from the daily index (``date, route, fare``); a missing fare counts as 0."""
    dates = index_long.select("date").distinct().orderBy(F.desc("date")).limit(2)
    recent = index_long.join(dates, "date", "left_semi")
    latest = index_long.select(F.max("date")).scalar()
    is_last = F.col("date") == latest
    pair = recent.groupBy("route").agg(
        F.coalesce(F.max(F.when(is_last, F.col("fare"))), F.lit(0.0)).alias("current_fare"),
        F.max(F.when(~is_last, F.col("fare"))).alias("previous_fare"))
    before = F.coalesce("previous_fare", "current_fare")
    change = F.coalesce(_percent(F.col("current_fare") - before, before), F.lit(0.0))
    return pair.select("route", S.rounded(change, 2).alias("pct_change"), "current_fare")


def day_over_day(daily: DataFrame) -> DataFrame:
    """Change of every route fare against the route's previous available date."""
    order = Window.partitionBy("route").orderBy("scraped_date")
    before = F.coalesce(F.lag("fare").over(order), F.col("fare"))
    change = F.coalesce(_percent(F.col("fare") - before, before), F.lit(0.0))
    return daily.select("scraped_date", "route", S.rounded(change, 2).alias("pct_change"))


# --- route products -----------------------------------------------------------------

def route_contribution(flagged: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Share of each route in the weighted fare level, from upper-middle medians."""
    medians = exact_order_stats(accepted(flagged), ["route"], "total_fare",
                                {"median_fare": UPPER_MIDDLE}, rescan=True)
    table = route_weights(flagged.sparkSession, weights or C.WEIGHTS_V2)
    weighted = (medians.join(table, "route", "left")
                .withColumn("weight", F.coalesce("weight", F.lit(0.0)))
                .withColumn("weighted_fare", F.col("median_fare") * F.col("weight")))
    # one row per route
    total = F.sum("weighted_fare").over(Window.partitionBy())
    share = F.when(total > 0, S.rounded(100 * F.col("weighted_fare") / total, 1)).otherwise(
        F.lit(0.0))
    return (weighted.select("route", "weight", "median_fare",
                            S.rounded(F.col("weighted_fare"), 4).alias("weighted_fare"),
                            share.alias("contribution"))
            .orderBy(F.desc("contribution"), "route"))


def provenance_stats(quotes: DataFrame) -> DataFrame:
    """Quotes and success rate per route, and for all routes together (``ALL``)."""
    ok = F.count_if(F.col("status") == "ok")
    return (quotes.where(F.col("route").isNotNull()).rollup("route")
            .agg(F.count(F.lit(1)).alias("samples"), ok.alias("ok_rows"),
                 S.rounded(100 * ok / F.count(F.lit(1)), 1).alias("success_rate"))
            .withColumn("route", F.coalesce("route", F.lit("ALL"))))


def lead_time_curve(quotes: DataFrame) -> DataFrame:
    """Mean ok fare per route and horizon, in whole rupees."""
    ok = quotes.where((F.col("status") == "ok") & F.col("total_fare").isNotNull())
    return ok.groupBy("route", "advance_purchase_days").agg(
        F.round(F.avg("total_fare"), 0).alias("value"))


def class_gap(flagged: DataFrame) -> DataFrame:
    """Business fare as a multiple of the economy fare; null on too few quotes."""
    good = accepted(flagged).where(F.col("total_fare").isNotNull())
    cabin = F.lower("fare_class")

    def mean_of(name: str) -> Column:
        return F.avg(F.when(cabin == name, F.col("total_fare")))

    n_business, n_economy = (F.count_if(cabin == name) for name in ("business", "economy"))
    enough = (n_business >= 2) & (n_economy >= 1) & (mean_of("economy") > 0)
    return good.groupBy("route").agg(
        n_business.alias("business_quotes"), n_economy.alias("economy_quotes"),
        F.when(enough, S.rounded(mean_of("business") / F.when(
            mean_of("economy") > 0, mean_of("economy")), 1)).alias("multiplier"))


def fare_sample(flagged: DataFrame, tie: list[str], size: int = 8) -> DataFrame:
    """A representative sample per route: one outlier, one sold-out row, then a round robin
    over carriers and horizons, newest first.

    Ranking is done per (route, carrier, horizon) first, where Spark keeps only the first
    rows of each task, and the few survivors are ranked per route.
    """
    newest = [F.col("scraped_ts").desc_nulls_last(), *tie]
    status = F.col("status")
    odd = (status == "parse_error") | F.col("outlier_flag")

    def first_rows(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
        return (rows.withColumn("_round", F.row_number().over(
            Window.partitionBy(*keys).orderBy(*newest))).where(F.col("_round") <= n))

    outlier = first_rows(flagged.where(odd), ["route"], 1).withColumn("_group", F.lit(0))
    sold = first_rows(flagged.where((status == "sold_out") & ~odd), ["route"], 1).withColumn(
        "_group", F.lit(1))
    active = first_rows(accepted(flagged), ["route", "carrier_name", "advance_purchase_days"],
                        size).withColumn("_group", F.lit(2))
    turn = Window.partitionBy("route").orderBy(
        "_group", "_round", "advance_purchase_days", "carrier_name", *newest)
    return (outlier.unionByName(sold).unionByName(active)
            .withColumn("sample_place", F.row_number().over(turn))
            .where(F.col("sample_place") <= size).drop("_group", "_round"))


def route_trajectory(flagged: DataFrame) -> DataFrame:
    """Upper-middle median per booking window of every route.

    A missing window borrows from its neighbours, longest window first, and says so in
    ``is_interpolated``.
    """
    good = accepted(flagged)
    by_window = exact_order_stats(good, ["route", "advance_purchase_days"], "total_fare",
                                  {"fare": UPPER_MIDDLE}, rescan=True)
    overall = exact_order_stats(good, ["route"], "total_fare", {"route_median": UPPER_MIDDLE}, rescan=True)
    wide = (by_window.groupBy("route").pivot("advance_purchase_days", C.HORIZONS)
            .agg(F.max("fare")).join(overall, "route"))
    seen = {h: F.when(F.col(f"`{h}`") != 0, F.col(f"`{h}`")) for h in C.HORIZONS}
    level = F.col("route_median")
    t45 = F.coalesce(seen[45], seen[30], F.round(level * 0.9))
    t30 = F.coalesce(seen[30], t45)
    t15 = F.coalesce(seen[15], t30)
    t7 = F.coalesce(seen[7], t15)
    t1 = F.coalesce(seen[1], F.round(t7 * 1.2))
    values = {1: t1, 7: t7, 15: t15, 30: t30, 45: t45}
    entries = [F.struct(F.lit(f"T+{h}").alias("window"), F.lit(h).alias("advance_purchase_days"),
                        values[h].alias("value"), seen[h].isNull().alias("is_interpolated"))
               for h in C.HORIZONS]
    return wide.select("route", F.inline(F.array(*entries)))


def seasonal_baseline(flagged: DataFrame, days: int = 30, date: str = "scraped_date",
                      as_of: str | None = None) -> DataFrame:
    """Median fare per route and window over the trailing days before the newest date."""
    good = accepted(flagged)
    newest = F.lit(as_of) if as_of else good.select(F.max(date)).scalar()
    start = F.date_sub(newest.cast("date"), days)
    trailing = good.where((F.col(date).cast("date") > start) & (F.col(date) <= newest))
    return exact_median(trailing, ["route", "advance_purchase_days"], "total_fare", "baseline", rescan=True)


def trajectory_with_baseline(trajectory: DataFrame, baseline: DataFrame) -> DataFrame:
    return trajectory.join(baseline, ["route", "advance_purchase_days"], "left")


def book_or_wait(trajectory: DataFrame, baseline: DataFrame, window: int = 15,
                 band: float = C.SIGNAL_BAND) -> DataFrame:
    """Booking signal: the window's current fare against its trailing median."""
    both = (trajectory_with_baseline(trajectory, baseline)
            .where((F.col("advance_purchase_days") == window) & (F.col("baseline") > 0))
            .withColumn("diff", _percent(F.col("value") - F.col("baseline"), F.col("baseline"))))
    signal = F.when(F.col("diff") <= -band, F.lit("GREEN")).when(
        F.col("diff") >= band, F.lit("RED")).otherwise(F.lit("AMBER"))
    return both.select("route", F.col("value").alias("current_fare"),
                       F.col("baseline").alias("trailing_median"),
                       S.rounded(F.col("diff"), 1).alias("diff_pct"), signal.alias("signal"))


def route_volatility(quotes: DataFrame) -> DataFrame:
    """Coefficient of variation per route and day with its band."""
    ok = quotes.where((F.col("status") == "ok") & F.col("total_fare").isNotNull())
    spread = ok.groupBy("scraped_date", "route").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.avg("total_fare").alias("_mean"),
        F.stddev_samp("total_fare").alias("_std"))
    cv = S.rounded(F.col("_std") / F.when(F.col("_mean") != 0, F.col("_mean")), 4)
    low, high = C.VOLATILITY_BANDS
    label = F.when(cv.isNull(), F.lit("PENDING")).when(cv < low, F.lit("STABLE")).when(
        cv < high, F.lit("ELEVATED")).otherwise(F.lit("HIGH"))
    return spread.select("scraped_date", "route", "n_quotes", cv.alias("cv"), label.alias("band"))


def ota_direct_comparison(pairs: DataFrame, band: float = C.SIGNAL_BAND) -> DataFrame:
    """Agent against direct fare per flight, marked where they differ by more than the band."""
    gap = F.col("ota_fare") - F.col("dir_fare")
    pct = _percent(gap, F.col("dir_fare"))
    return pairs.select(*[c for c in pairs.columns if c not in ("ota_fare", "dir_fare")],
                        "dir_fare", "ota_fare", S.rounded(gap, 2).alias("delta"),
                        S.rounded(pct, 2).alias("delta_pct"),
                        F.coalesce(F.abs(S.rounded(pct, 4)) > band, F.lit(False)).alias("differs"))


def intraday_range(quotes: DataFrame) -> DataFrame:
    ok = quotes.where((F.col("status") == "ok") & F.col("total_fare").isNotNull())
    return ok.groupBy("scraped_date", "route").agg(
        F.min("total_fare").alias("low"), F.max("total_fare").alias("high"))


def sold_out_rate(quotes: DataFrame) -> DataFrame:
    return quotes.groupBy("scraped_date", "route").agg(
        F.count(F.lit(1)).alias("n_quotes"),
        S.rounded(F.avg(F.when(F.col("status") == "sold_out", 1.0).otherwise(0.0)), 4)
        .alias("sold_out_rate"))


def distinct_values(quotes: DataFrame, column: str) -> DataFrame:
    return quotes.select(column).dropna().distinct()


def backtest(daily: DataFrame, reference: DataFrame, value: str = "composite_fare_index"
             ) -> DataFrame:
    """Correlation and mean absolute error in per cent against a monthly series.

    ``reference`` has ``month`` (text, first day) and ``reference_value``.
    """
    month = F.date_format(F.trunc(F.col("date").cast("date"), "month"), "yyyy-MM-dd")
    monthly = daily.groupBy(month.alias("month")).agg(F.avg(value).alias("value"))
    both = monthly.join(reference, "month")
    error = F.abs(F.col("value") - F.col("reference_value")) / F.when(
        F.col("reference_value") != 0, F.abs("reference_value"))
    return both.agg(F.count(F.lit(1)).alias("n_months"),
                    S.rounded(F.corr("value", "reference_value"), 4).alias("correlation"),
                    S.rounded(100 * F.avg(error), 2).alias("mape"))
