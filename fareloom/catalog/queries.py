"""Registered queries: every operator over the whole test tables.

Each takes a session and the folder with the tables and returns a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..operators import coverage, dedup, filters, forecast, forest, normalize, outliers, pages
from ..operators import quality, running
from ..operators.order_stats import UPPER_MIDDLE, exact_order_stats
from ..plans import daily_composite as dc
from ..plans import fare_index as fi
from ..plans import products
from ..session import materialise
from ..sources import star
from ..sources.weights import weight_versions

QUERIES = {}
ID = star.ROW_ID
W1, W2, BASKET = star.BASKET_WEIGHTS, star.BASKET_WEIGHTS_V2, star.BASKET
NOW = "2001-08-06T00:00:00+00:00"
SPLIT = "2000-01-01"
ORDER = ["scraped_date", *ID]


def query(build):
    QUERIES[build.__name__] = build
    return build


# --- shared inputs ------------------------------------------------------------------
#
# As in a daily run, quotes and flagged quotes are stage tables: written once per
# application and read by every query that needs them.

_STAGES = {}


def _key(spark: SparkSession, folder: str, name: str) -> tuple:
    return spark.sparkContext.applicationId, folder.rstrip("/"), name


def _stage(spark: SparkSession, folder: str, name: str, build) -> DataFrame:
    key = _key(spark, folder, name)
    if key not in _STAGES:
        _STAGES[key] = materialise(build(spark, folder), name.split(":")[0])
    return _STAGES[key]


def _quotes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The quotes, or some columns of them: what a query does not read is neither shuffled nor written for it."""
    if not columns:
        return _stage(spark, folder, "quotes", star.fare_quotes)
    whole = _STAGES.get(_key(spark, folder, "quotes"))

    def build(s, d):
        quotes = star.fare_quotes(s, d)
        return quotes.select(*[c for c in quotes.columns if c in columns])
    if whole is not None:
        return whole.select(*[c for c in whole.columns if c in columns])
    return _stage(spark, folder, "quotes:" + ",".join(sorted({*columns})), build)


def _unflagged(spark, folder, *columns) -> DataFrame:
    return _quotes(spark, folder, *columns).withColumns({
        "confidence_score": F.lit(1.0), "quality_flags": F.array().cast("array<string>")})


def _mad(spark, folder, *columns) -> DataFrame:
    """``columns`` and those of the index, with the statistical flag; the limits are stored, the rows are not once more."""
    return outliers.flag_mad(_unflagged(spark, folder, *columns, *outliers.MAD_KEYS, "scraped_date", "status", "total_fare"))


def _stale(spark, folder) -> DataFrame:
    checks = quality.oldest_verified(star.selector_checks(spark, folder))
    known = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEW"]
    return quality.stale_sources(checks, NOW, known)


def _score(spark, folder, *columns) -> DataFrame:
    return quality.quality_scores(_quotes(spark, folder, *columns), _stale(spark, folder))


def _scored(spark, folder, *columns) -> DataFrame:
    """The rows' numbers, ``columns`` and those that the rules read, with score and flags."""
    return _score(spark, folder, *ID, *columns, *quality.CONFIRM_KEYS, "source_scraper", "total_fare", "status",
                  "data_source_method", "fare_split_estimated")


def _iqr(spark, folder, *columns) -> DataFrame:
    """Quotes (or ``columns`` and those of the bounds) with ``outlier_flag``; the bounds are stored, the rows are not once more."""
    needed = [*columns, *outliers.IQR_KEYS, "status", "total_fare"] if columns else []
    return outliers.flag_iqr(_quotes(spark, folder, *needed))


def _daily_index(spark, folder) -> DataFrame:
    return fi.fare_index_daily(_mad(spark, folder), W1, BASKET)


def _index(spark, folder) -> DataFrame:
    return _stage(spark, folder, "index", _daily_index)


def _index_long(spark, folder) -> DataFrame:
    return fi.lengthen(_index(spark, folder), BASKET)


def _medians(spark, folder) -> DataFrame:
    return _stage(spark, folder, "medians", lambda s, d: fi.horizon_medians(filters.index_eligible(_mad(s, d))))


def _daily_flagged(spark, folder) -> DataFrame:
    """Each month's deduplicated quotes with their outlier mark; the quotes are stored, the marks follow from stored bounds.

    Only columns that the composite reads are shuffled, with those that come before them when ties are broken.
    """
    read = ["scraped_date", *C.DAILY_KEYS, "carrier_name", "total_fare", "status", "source"]
    key = _key(spark, folder, "flagged-days")
    if key not in _STAGES:
        # the bounds of the history are taken from the same stored columns
        quotes = _quotes(spark, folder, *ID, *read, "scraped_ts", "capture_run")
        history = outliers.history_maximum(outliers.flag_iqr(quotes))
        _STAGES[key] = dc.flagged_quotes(quotes, history, columns=read)
    return _STAGES[key]


def _raw(spark, folder) -> DataFrame:
    return star.raw_captures(_quotes(spark, folder))


def _normalized(spark, folder) -> DataFrame:
    return normalize.normalize(_raw(spark, folder))


def _flag_text(df: DataFrame) -> DataFrame:
    return df.withColumn("quality_flags", F.concat_ws(",", "quality_flags"))


# --- values -------------------------------------------------------------------------

@query
def fare_quotes(spark, folder):
    return star.fare_quotes(spark, folder).drop("scraped_ts")


@query
def route_weight_quotes(spark, folder):
    weights = weight_versions(spark, {"v1": W1, "v2": W2})
    counts = _quotes(spark, folder).groupBy("route").agg(F.count(F.lit(1)).alias("n_quotes"))
    return weights.join(counts, "route", "left").select("version", "route", "weight", "n_quotes")


@query
def number_parsing(spark, folder):
    text = F.col("total_fare")
    return _raw(spark, folder).select(*ID, S.parse_number(text).alias("fare"),
                                      S.number_is_bad(text).alias("is_bad"))


@query
def flag_parsing(spark, folder):
    return _raw(spark, folder).select(*ID, S.parse_flag(F.col("fare_split_estimated")).alias("flag"))


@query
def fare_classes(spark, folder):
    return _raw(spark, folder).select(*ID, S.fare_class_name(F.col("fare_class")).alias("fare_class"))


@query
def horizon_parsing(spark, folder):
    return _raw(spark, folder).select(
        *ID, S.parse_horizon(F.col("advance_purchase_days")).alias("horizon"))


@query
def status_mapping(spark, folder):
    return _raw(spark, folder).select(*ID, S.canonical_status(F.col("status")).alias("status"))


@query
def source_inference(spark, folder):
    scraper = F.col("source_scraper")
    return _raw(spark, folder).select(
        *ID, S.source_kind(F.col("source"), scraper).alias("source"),
        S.source_label(F.col("source_name"), scraper).alias("source_name"))


@query
def valid_quotes(spark, folder):
    return normalize.valid_quotes(_normalized(spark, folder)).select(
        "origin", "destination", "flight_num", "travel_date", "advance_purchase_days",
        "fare_class", "base_fare", "taxes_and_fees", "total_fare", "fare_split_estimated",
        "status", "scraped_at", "source", "source_name", "source_scraper", "data_source_method")


@query
def rejected_quotes(spark, folder):
    rejects = normalize.rejected_rows(_normalized(spark, folder))
    return rejects.select("source_file", "error",
                          F.get_json_object("raw_row", "$.total_fare").alias("raw_fare"))


@query
def rejection_reasons(spark, folder):
    return normalize.rejection_reasons(normalize.rejected_rows(_normalized(spark, folder)))


@query
def route_names(spark, folder):
    name = S.route_name(F.col("origin"), F.col("destination")).alias("route")
    return _raw(spark, folder).select(*ID, name)


@query
def capture_dates(spark, folder):
    stamp = F.col("scraped_at")
    return _quotes(spark, folder).select(*ID, S.utc_date(stamp).alias("utc_date"),
                                         S.text_date(stamp).alias("text_date"))


@query
def carrier_resolution(spark, folder):
    def pick(column, words):
        return F.element_at(F.array(*[F.lit(w) for w in words]), (column % len(words) + 1).cast("int"))
    rows = _quotes(spark, folder).select(
        *ID, F.concat(pick(F.col("part_key"), ["6E", "ai", " IX ", "SG", "QP", "ZZ", "K"]),
                      F.lit("-"), F.col("part_key").cast("string")).alias("flight"),
        pick(F.col("supp_key"), ["IndiGo Airlines", "Air India Express", "air india", "SpiceJet",
                                 "Akasa", "Vistara", ""]).alias("name"))
    code = S.carrier_code(F.col("flight"), F.col("name"))
    return rows.select(*ID, code.alias("carrier_code"),
                       S.carrier_label(code, F.col("name")).alias("carrier_name"))


@query
def fare_split_estimates(spark, folder):
    base = S.estimated_base_fare(F.col("price"))
    return _quotes(spark, folder).select(
        *ID, base.alias("base_fare"), S.rounded(F.col("price") - base, 2).alias("taxes_and_fees"))


@query
def travel_weekdays(spark, folder):
    return _quotes(spark, folder).select(
        *ID, S.weekday_number(F.col("travel_date")).alias("day_of_week"))


@query
def rupee_texts(spark, folder):
    whole = F.floor("price").cast("long")
    text = F.concat(F.lit("₹ "), F.floor(whole / 1000).cast("string"), F.lit(","),
                    F.lpad((whole % 1000).cast("string"), 3, "0"))
    return _quotes(spark, folder).select(*ID, S.rupee_amount(text).alias("amount"))


@query
def export_cleaning(spark, folder):
    rows = _quotes(spark, folder).select(
        *ID, F.coalesce("total_fare", F.lit(float("nan"))).alias("total_fare"),
        F.when(F.col("status") == "ok", F.col("status")).alias("status"))
    return normalize.for_export(rows, blank_text=True)


@query
def chip_classes(spark, folder):
    chip = (F.when(F.col("part_key") % 5 == 0, F.lit("Stretch Plus"))
            .when(F.col("part_key") % 5 == 1, F.lit("BUSINESS flexi"))
            .when(F.col("part_key") % 5 == 2, F.lit("Sold Out")).otherwise(F.lit("Saver")))
    return _quotes(spark, folder).select(*ID, S.chip_fare_class(chip).alias("fare_class"),
                                         S.chip_sold_out(chip).alias("sold_out"))


# --- filters ------------------------------------------------------------------------

@query
def index_eligible(spark, folder):
    return filters.index_eligible(_mad(spark, folder, *ID)).select(*ID, "route", "total_fare")


@query
def excluded_fare_audit(spark, folder):
    return fi.excluded_fares(_mad(spark, folder, *ID)).select(*ID, "status", "exclusion_reason")


@query
def direct_basket(spark, folder):
    return filters.direct_basket(_iqr(spark, folder, *ID, "source", "carrier_name")).select(*ID, "total_fare")


@query
def agent_basket(spark, folder):
    return filters.agent_basket(_iqr(spark, folder, *ID, "source")).select(*ID, "total_fare")


@query
def crosscheck_candidates(spark, folder):
    return filters.crosscheck_candidates(_quotes(spark, folder)).select(*ID, "total_fare")


@query
def fares_recent(spark, folder):
    return products.fares_recent(_quotes(spark, folder), 24 * 30).select(*ID, "scraped_at")


@query
def fares_of_latest_date(spark, folder):
    return products.fares_of_latest_date(_quotes(spark, folder)).select(*ID, "scraped_date")


@query
def rows_with_flag(spark, folder):
    return _flag_text(filters.with_flag(_scored(spark, folder), "fare_estimated")).select(
        *ID, "quality_flags")


@query
def rows_with_any_flag(spark, folder):
    return _flag_text(filters.with_flag(_scored(spark, folder))).select(*ID, "quality_flags")


@query
def confident_rows(spark, folder):
    return filters.min_confidence(_scored(spark, folder), 0.8).select(*ID, "confidence_score")


@query
def route_carrier_fares(spark, folder):
    return filters.by_route_and_carrier(_quotes(spark, folder), "ASIA-EUROPE", "Machinery").select(
        *ID, "total_fare")


@query
def airport_discards(spark, folder):
    cards = pages.read_cards(star.card_pages(_quotes(spark, folder)), pages.DIRECT_CARDS)
    return filters.split_alternate_airports(cards)[1]


@query
def plausible_fares(spark, folder):
    fare = F.col("price")
    return _quotes(spark, folder).select(
        *ID, filters.plausible_direct(F.floor(fare).cast("double")).alias("direct_ok"),
        filters.agent_status(fare, F.col("flight_num")).alias("agent_status"))


# --- joins and duplicates -----------------------------------------------------------

@query
def appended_quotes(spark, folder):
    quotes = _quotes(spark, folder)
    fresh = dedup.append_new(quotes.where(F.col("capture_day") < SPLIT), quotes)
    return fresh.select(*ID, "flight_num", "capture_run")


@query
def iqr_bounds(spark, folder):
    return outliers.iqr_bounds(_quotes(spark, folder)).select(
        "origin", "destination", "advance_purchase_days",
        S.rounded(F.col("lower_bound"), 4).alias("lower_bound"), S.rounded(F.col("upper_bound"), 4).alias("upper_bound"))


@query
def quotes_with_bounds(spark, folder):
    quotes = _quotes(spark, folder)
    return outliers.attach_bounds(quotes, outliers.iqr_bounds(quotes)).select(
        *ID, S.rounded(F.col("lower_bound"), 4).alias("lower_bound"),
        S.rounded(F.col("upper_bound"), 4).alias("upper_bound"))


@query
def group_features(spark, folder):
    quotes = _quotes(spark, folder)
    features = materialise(outliers.group_features(quotes), "features")
    return quotes.join(features, outliers.MAD_KEYS, "left").select(
        *ID, S.rounded(F.col("grp_mean"), 2).alias("grp_mean"), S.rounded(F.col("grp_std"), 2).alias("grp_std"))


@query
def confirmed_keys(spark, folder):
    return quality.confirmed_keys(_quotes(spark, folder))


@query
def confirmed_quotes(spark, folder):
    return quality.mark_confirmed(_quotes(spark, folder)).select(*ID, "cross_source_confirmed")


@query
def history_maximum(spark, folder):
    return outliers.history_maximum(_iqr(spark, folder, "origin"))


@query
def route_index(spark, folder):
    indexed = fi.route_index(fi.route_days(_medians(spark, folder)))
    return indexed.select("scraped_date", "route", S.rounded(F.col("fare"), 2).alias("fare"),
                          S.rounded(F.col("index"), 2).alias("index"))


@query
def coverage_gaps(spark, folder):
    return coverage.coverage_gaps(_quotes(spark, folder), by=["scraped_date"])


@query
def stale_sources(spark, folder):
    return _stale(spark, folder)


@query
def trajectory_with_baseline(spark, folder):
    flagged = _iqr(spark, folder, "route", "capture_day")
    both = products.trajectory_with_baseline(
        products.route_trajectory(flagged),
        products.seasonal_baseline(flagged, 30, "capture_day"))
    return both.select("route", "window", "value", "is_interpolated",
                       S.rounded(F.col("baseline"), 2).alias("baseline"))


@query
def latest_quotes(spark, folder):
    return dedup.keep_latest(_quotes(spark, folder)).select(*ID, "scraped_at")


@query
def latest_quotes_by_source(spark, folder):
    return dedup.keep_latest(_quotes(spark, folder), keep_sources=True).select(*ID, "source")


@query
def page_duplicates(spark, folder):
    place = F.col("line_number").cast("long") * 10**12 + F.round(F.col("price") * 100).cast("long")
    cards = _quotes(spark, folder).withColumn("position", place)
    return dedup.dedup_in_page(cards, ["order_key", "flight_num"]).select(
        "order_key", "flight_num", "position", "status")


@query
def union_of_parts(spark, folder):
    quotes = _quotes(spark, folder)
    early = quotes.where(F.col("capture_day") < SPLIT).select(*ID, "route")
    late = quotes.where(F.col("capture_day") >= SPLIT).select("total_fare", *ID)
    return dedup.union_all(early, late)


# --- aggregations -------------------------------------------------------------------

@query
def horizon_medians(spark, folder):
    return _medians(spark, folder).withColumn("fare", S.rounded(F.col("fare"), 2))


@query
def route_day_fares(spark, folder):
    return fi.route_days(_medians(spark, folder)).withColumn("fare", S.rounded(F.col("fare"), 2))


@query
def data_completeness(spark, folder):
    fares = fi.route_days(_medians(spark, folder))
    whole = fi.day_summary(fares, W1, BASKET)
    return whole.select("scraped_date", "data_completeness")


@query
def composite_fares(spark, folder):
    fares = fi.route_days(_medians(spark, folder))
    return fi.day_summary(fares, W1, BASKET).select("scraped_date", "composite_daily_fare")


@query
def composite_fares_unweighted(spark, folder):
    fares = fi.route_days(_medians(spark, folder))
    return fi.day_summary(fares, None, BASKET).select("scraped_date", "composite_daily_fare")


@query
def horizon_composites(spark, folder):
    return dc.horizon_composite(_iqr(spark, folder, "scraped_date", "source", "carrier_name"), W2).withColumn(
        "composite", S.rounded(F.col("composite"), 2))


@query
def agent_premium(spark, folder):
    pairs = dc.flight_pairs(_iqr(spark, folder), day=None)
    return dc.agent_premium(pairs, day=None).withColumn("premium", S.rounded(F.col("premium"), 2))


@query
def mad_groups(spark, folder):
    return outliers.mad_table(_quotes(spark, folder)).withColumns({
        "median": S.rounded(F.col("median"), 4), "mad": S.rounded(F.col("mad"), 4)})


@query
def completed_horizons(spark, folder):
    return coverage.completed_horizons(_quotes(spark, folder), min_routes=3)


@query
def failed_sources(spark, folder):
    return coverage.failed_sources(_quotes(spark, folder))


@query
def flag_counts(spark, folder):
    return quality.flag_counts(_scored(spark, folder))


@query
def score_summary(spark, folder):
    return quality.score_summary(_scored(spark, folder))


@query
def route_trend(spark, folder):
    return products.route_trend(_quotes(spark, folder))


@query
def daily_headline(spark, folder):
    return products.daily_headline(dc.daily_composite(_daily_flagged(spark, folder), W2))


@query
def provenance_stats(spark, folder):
    return products.provenance_stats(_quotes(spark, folder))


@query
def route_contribution(spark, folder):
    return products.route_contribution(_iqr(spark, folder, "route"), W2)


@query
def lead_time_curve(spark, folder):
    return products.lead_time_curve(_quotes(spark, folder))


@query
def class_gap(spark, folder):
    return products.class_gap(_iqr(spark, folder, "route", "fare_class"))


@query
def selector_ages(spark, folder):
    oldest = quality.oldest_verified(star.selector_checks(spark, folder))
    return oldest.select("site", F.date_format("oldest_verified_at", "yyyy-MM-dd").alias("oldest"))


@query
def distinct_carriers(spark, folder):
    return products.distinct_values(_quotes(spark, folder), "carrier_name")


@query
def distinct_routes(spark, folder):
    return products.distinct_values(_quotes(spark, folder), "route")


# --- windows ------------------------------------------------------------------------

@query
def upper_middle_medians(spark, folder):
    return exact_order_stats(_quotes(spark, folder), ["route", "advance_purchase_days"],
                             "total_fare", {"fare": UPPER_MIDDLE})


@query
def day_over_day(spark, folder):
    return products.day_over_day(fi.route_days(_medians(spark, folder)))


@query
def headline_change(spark, folder):
    return fi.headline_change(_index(spark, folder))


@query
def fare_sample(spark, folder):
    return products.fare_sample(_iqr(spark, folder), ID).select(
        "route", "sample_place", *ID, "status")


@query
def failure_runs(spark, folder):
    events = star.table(spark, folder, "events")
    runs = running.failure_runs(events, "user_id", "ts", "event_id",
                                F.col("event_type") == "error", 3)
    text = "yyyy-MM-dd HH:mm:ss"
    return runs.select("user_id", "run_length", F.date_format("run_start", text).alias("run_start"),
                       F.date_format("run_end", text).alias("run_end"))


@query
def rebased_route_fares(spark, folder):
    return products.rebased_route_fares(_index_long(spark, folder), 30)


# --- quality, outliers, models ------------------------------------------------------

@query
def quality_scores(spark, folder):
    return _flag_text(_scored(spark, folder)).select(*ID, "confidence_score", "quality_flags")


@query
def mad_flags(spark, folder):
    return _flag_text(outliers.flag_mad(_scored(spark, folder, *outliers.MAD_KEYS))).select(
        *ID, "confidence_score", "quality_flags")


@query
def iqr_flags(spark, folder):
    return outliers.flag_iqr(_quotes(spark, folder)).select(*ID, "outlier_flag")


def _forest(spark, folder, *columns) -> DataFrame:
    """The columns of the model and ``columns``, with score and flag: every row is shuffled to its point."""
    return forest.flag_forest(_unflagged(spark, folder, *columns, *outliers.MAD_KEYS, "travel_date", "status", "total_fare")
                              .drop("confidence_score"))


@query
def forest_features(spark, folder):
    return forest.forest_points(_unflagged(spark, folder, *outliers.MAD_KEYS, "travel_date", "status", "total_fare")).groupBy("route", "carrier_code", "advance_days", "day_of_week").agg(
        F.count("*").alias("n_rows"), S.rounded(F.sum(F.col("fare").cast("decimal(20,2)")).cast("double"), 2).alias("fares"))


@query
def forest_summary(spark, folder):
    flagged = F.array_contains("quality_flags", C.FLAG_MODEL)
    return _forest(spark, folder).groupBy("route").agg(
        F.count("*").alias("n_rows"), F.count_if(flagged).alias("n_flagged"),
        F.count_if(F.col("anomaly_score") != 0).alias("n_scored"), F.max("anomaly_score").alias("highest"))


@query
def forest_flags(spark, folder):
    return _flag_text(_forest(spark, folder, *ID)).select(*ID, "route", "anomaly_score", "quality_flags")


@query
def event_forecast(spark, folder):
    return forecast.forecast_series(star.event_series(spark, folder))


@query
def index_forecast(spark, folder):
    return products.forecast_for(forecast.forecast_index(_index(spark, folder)),
                                 "asia-europe")


# --- products -----------------------------------------------------------------------

@query
def fare_index_daily(spark, folder):
    return _daily_index(spark, folder)


@query
def daily_composite(spark, folder):
    return dc.daily_composite(_daily_flagged(spark, folder), W2)


@query
def index_latest(spark, folder):
    return products.index_latest(_index(spark, folder))


@query
def index_history(spark, folder):
    return products.index_history(_index(spark, folder), "asia-europe", 30)


@query
def quality_flag_page(spark, folder):
    page = products.quality_flags(_scored(spark, folder), ORDER, 0.5, "stale_selector", 100)
    return _flag_text(page).select(*ORDER, "confidence_score", "quality_flags")


@query
def route_heatmap(spark, folder):
    return products.route_heatmap(_iqr(spark, folder, "route", "scraped_date"), W2)


@query
def index_heatmap(spark, folder):
    return products.index_heatmap(_index_long(spark, folder))


@query
def route_heatmap_sorted(spark, folder):
    return products.sorted_by(products.route_heatmap(_iqr(spark, folder, "route", "scraped_date"), W2), "route", True)


@query
def route_trajectory(spark, folder):
    return products.route_trajectory(_iqr(spark, folder, "route"))


@query
def seasonal_baseline(spark, folder):
    return products.seasonal_baseline(_iqr(spark, folder, "route", "capture_day"), 30, "capture_day").withColumn(
        "baseline", S.rounded(F.col("baseline"), 2))


@query
def book_or_wait(spark, folder):
    flagged = _iqr(spark, folder, "route", "capture_day")
    return products.book_or_wait(products.route_trajectory(flagged),
                                 products.seasonal_baseline(flagged, 30, "capture_day")).withColumn(
        "trailing_median", S.rounded(F.col("trailing_median"), 2))


@query
def route_volatility(spark, folder):
    return products.route_volatility(_quotes(spark, folder))


@query
def ota_direct_comparison(spark, folder):
    flagged = _iqr(spark, folder)
    return products.ota_direct_comparison(dc.flight_pairs(flagged, day=None)).withColumns({
        "dir_fare": S.rounded(F.col("dir_fare"), 2), "ota_fare": S.rounded(F.col("ota_fare"), 2)})


@query
def intraday_range(spark, folder):
    return products.intraday_range(_quotes(spark, folder))


@query
def sold_out_rate(spark, folder):
    return products.sold_out_rate(_quotes(spark, folder))


@query
def index_long(spark, folder):
    return _index_long(spark, folder)


@query
def index_wide(spark, folder):
    return fi.widen(fi.route_index(fi.route_days(_medians(spark, folder))), BASKET)


@query
def backtest(spark, folder):
    month = F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd")
    reference = (star.table(spark, folder, "orders").groupBy(month.alias("month"))
                 .agg(F.avg("o_totalprice").alias("reference_value")))
    return products.backtest(_index(spark, folder), reference, "composite_daily_fare")


# --- pages --------------------------------------------------------------------------

@query
def clean_pages(spark, folder):
    html = star.table(spark, folder, "pages")
    return html.select("page_id", pages.clean_html(F.col("html")).alias("html"))


@query
def compact_pages(spark, folder):
    html = star.table(spark, folder, "pages")
    pieces = html.select("page_id", "html", pages.card_pieces(F.col("html")).alias("pieces"))
    return pieces.select("page_id", F.when(F.size("pieces") > 0, F.concat_ws("\n", "pieces"))
                         .otherwise(pages.clean_html(F.col("html"))).alias("html"))


@query
def card_pieces(spark, folder):
    html = star.priced_pages(spark, folder)
    return html.select("page_id", F.explode(pages.card_pieces(F.col("html"))).alias("piece"))


@query
def chip_cards(spark, folder):
    return pages.extract_chips(star.chip_pages(_quotes(spark, folder)))[0].select(
        "page_id", "carrier_code", "flight_num", "fare_class", "departure_time", "total_fare", "status")


@query
def agent_cards_second(spark, folder):
    return pages.extract_cards(star.second_agent_pages(_quotes(spark, folder)), pages.SECOND_AGENT_CARDS)[0].select(
        "page_id", "flight_num", "departure_time", "total_fare", "status", "source_name")


@query
def direct_cards(spark, folder):
    return pages.extract_cards(star.card_pages(_quotes(spark, folder)), pages.DIRECT_CARDS)[0].select(
        "page_id", "origin", "destination", "carrier_code", "carrier_name", "flight_num",
        "departure_time", "total_fare", "status")


@query
def agent_cards(spark, folder):
    return pages.extract_cards(star.agent_pages(_quotes(spark, folder, *star.SEARCHED)), pages.AGENT_CARDS)[0].select(
        "page_id", "carrier_code", "carrier_name", "flight_num", "departure_time", "total_fare",
        "status", "source")


@query
def line_offers(spark, folder):
    return pages.extract_lines(star.line_pages(_quotes(spark, folder))).select(
        "page_id", "flight_num", "departure_time", "total_fare", "status")


@query
def inline_offers(spark, folder):
    return pages.extract_inline(star.inline_pages(_quotes(spark, folder)))[0].select(
        "page_id", "flight_num", "departure_time", "base_fare", "taxes_and_fees", "total_fare")


@query
def placeholder_quotes(spark, folder):
    shown = ["page_id", "flight_num", "departure_time", "total_fare", "status"]
    lines = _quotes(spark, folder, *star.SEARCHED)
    searches = star.inline_pages(lines)
    # read twice from here on, so the pages are read once for both
    quotes = materialise(pages.extract_inline(searches)[0].select(*shown), "inline-quotes")
    return pages.with_placeholders(searches.repartition(star.tasks_of(lines), "page_id"), quotes).select(*shown)


@query
def page_health(spark, folder):
    rules = {"fare_card": (r"(?s)<li>(.*?)</li>", r"."),
             "origin_code": (r"(?s)<p>(.*?)</p>", r"\b[A-Z]{3}\b"),
             "total_fare": (r"(?s)<b>(.*?)</b>", r"₹[\d,]+|INR\s*[\d,]+")}
    return pages.extraction_health(star.table(spark, folder, "pages"), rules)
