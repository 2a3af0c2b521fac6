"""Registered queries that write given-table data to the work folder through an operator and read it back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..operators.normalize import normalize, valid_quotes
from ..plans import daily_composite as dc
from ..plans import incremental
from ..schema import RAW_COLUMNS
from ..session import materialise, run_folder
from ..sources import captures, metrics, registry, star, tables
from .oracles import DAYS, INDEX, QUOTES, SCORED, oracle
from .queries import BASKET, W1, W2, _daily_flagged, _quotes, _score, query


def _folder(spark) -> str:
    return os.path.join(run_folder(spark), f"round-trip-{uuid.uuid4().hex}")


@query
def captures_round_trip(spark, folder):
    """Quotes as capture files with quotes, commas and line breaks in a name."""
    quotes = _quotes(spark, folder).withColumns({
        "carrier_name": F.concat(F.lit('He said "'), "carrier_name", F.lit('", then\nleft')),
        "base_fare": F.lit(None).cast("string"), "taxes_and_fees": F.lit(None).cast("string"),
        "departure_time": F.lit("10:30")})
    path = _folder(spark)
    tables.append_csv(quotes.select(*[F.col(c).cast("string").alias(c) for c in RAW_COLUMNS]), path)
    return valid_quotes(normalize(captures.read_raw_quotes(spark, path))).select(
        "origin", "destination", "carrier_name", "flight_num", "travel_date", "scraped_at", "status")


oracle("captures_round_trip", """
SELECT origin, destination, 'He said "' || carrier_name || '", then' || chr(10) || 'left' AS carrier_name, flight_num,
  travel_date, scraped_at, status FROM quotes""", QUOTES)


@query
def days_replaced(spark, folder):
    """All days written, then those of one half year once more: nothing doubles, nothing goes."""
    path, quotes = _folder(spark), _quotes(spark, folder).select("scraped_date", "route")
    tables.replace_days(quotes, path, "scraped_date")
    tables.replace_days(quotes.where(F.col("scraped_date") < "1995-07-01"), path, "scraped_date", ["route"])
    return tables.read_table(spark, path).groupBy("scraped_date", "route").agg(F.count("*").alias("n_rows"))


oracle("days_replaced", "SELECT scraped_date, route, count(*) AS n_rows FROM quotes GROUP BY 1, 2", QUOTES)


def _healing_log(spark, folder):
    events, path = star.table(spark, folder, "events"), _folder(spark)
    events.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.col("event_type").alias("site"),
        F.concat(F.lit("field"), (F.col("user_id") % 5).cast("string")).alias("target_field"),
        (F.col("event_id") % 3 == 0).alias("success"), F.col("event_id").cast("string").alias("selector")).write.json(path)
    return registry.read_healing_log(spark, path)


@query
def healing_rates(spark, folder):
    return registry.healing_summary(_healing_log(spark, folder)).drop("latest_selector")


oracle("healing_rates", """
SELECT event_type AS site, 'field' || CAST(user_id % 5 AS VARCHAR) AS target_field, count(*) AS attempts,
  count(*) FILTER (event_id % 3 = 0) AS successes,
  round(100 * count(*) FILTER (event_id % 3 = 0) / count(*), 1) AS success_pct FROM events GROUP BY 1, 2""")


@query
def healing_recent(spark, folder):
    return registry.recent_events(_healing_log(spark, folder)).select("timestamp")


oracle("healing_recent", """
SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp FROM events ORDER BY ts DESC LIMIT 50""")


@query
def index_incremental(spark, folder):
    """The index from three batches: most days, then the last two days, then late quotes of all days."""
    quotes, store = _quotes(spark, folder), _folder(spark)
    late, last = F.col("part_key") % 50 == 0, F.col("scraped_date") >= "1998-07-01"
    for batch, part in (("b1", ~late & ~last), ("b2", ~late & last), ("b3", late)):
        incremental.update_index(quotes.where(part), store, batch, W1, BASKET)
    return incremental.current_index(spark, store)


oracle("index_incremental", "SELECT * FROM index_daily", INDEX)


@query
def stage_metrics(spark, folder):
    """Measures of the scored stage, taken while it is written and read back from the metrics table."""
    path = _folder(spark)
    values = metrics.write_observed(_score(spark, folder), metrics.scored_metrics,
                                    lambda rows: tables.write_stage(rows, f"{path}/scored", "scraped_date"))
    metrics.save_metrics(spark, "run", "scored", 1.0, values, f"{path}/metrics")
    return metrics.read_metrics(spark, f"{path}/metrics").select(
        "stage", "rows", F.explode("metrics").alias("metric", "text")).select(
        "stage", "rows", "metric", F.round(F.col("text").cast("double"), 3).alias("value"))


oracle("stage_metrics", """
SELECT 'scored' AS stage, (SELECT count(*) FROM scored) AS rows, metric, round(value, 3) AS value FROM (
  SELECT 'mean_confidence_score' AS metric, avg(confidence_score) AS value FROM scored
  UNION ALL SELECT 'perfect_score_rows', count(*) FILTER (confidence_score = 1.0) FROM scored
  UNION ALL SELECT 'total_flagged_rows', count(*) FILTER (quality_flags <> '') FROM scored
  UNION ALL SELECT 'flag.' || flag, count(*) FROM (
    SELECT unnest(string_split(quality_flags, ',')) AS flag FROM scored) WHERE flag <> '' GROUP BY flag)""", SCORED)


@query
def selector_counts(spark, folder):
    """A registry file per site, with the selectors its events name; fields of a multiple of 3 await review."""
    path = _folder(spark)
    field = F.concat(F.lit("field"), (F.col("user_id") % 50).cast("string"))
    value = F.struct(F.lit("css").alias("value"), F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("last_verified_at"))
    fields = star.table(spark, folder, "events").groupBy("event_type", field.alias("field")).agg(value.alias("selector"))
    number = F.substring("field", 6, 9).cast("int")

    def chosen(condition):
        return F.map_from_entries(F.collect_list(F.when(condition, F.struct("field", "selector"))))

    sites = fields.groupBy("event_type").agg(chosen(number % 3 != 0).alias("selectors"),
                                             chosen(number % 3 == 0).alias("pending_review"))
    sites.withColumn("site", F.col("event_type")).write.partitionBy("event_type").json(path)
    registries = registry.read_registries(spark, path)
    newest = registry.registry_selectors(registries).groupBy("site").agg(F.max("last_verified_at").alias("last_verified_at"))
    return registry.selector_health(registries).join(newest, "site", "left")


oracle("selector_counts", """
SELECT event_type AS site, count(DISTINCT user_id % 50) FILTER (user_id % 50 % 3 <> 0)::INTEGER AS active_selectors,
  count(DISTINCT user_id % 50) FILTER (user_id % 50 % 3 = 0)::INTEGER AS pending_selectors,
  strftime(max(ts) FILTER (user_id % 50 % 3 <> 0), '%Y-%m-%dT%H:%M:%S') AS last_verified_at FROM events GROUP BY 1""")


_FILE_STEMS = [*[prefix for prefix, _ in C.SOURCE_PREFIXES], "Other_Site"]


@query
def scraper_names(spark, folder):
    """The scraper id of a capture file's name, for every known prefix and an unknown one."""
    stem = F.element_at(F.array(*map(F.lit, _FILE_STEMS)), (F.col("part_key") % len(_FILE_STEMS) + 1).cast("int"))
    name = F.concat(F.lit("/raw/"), "scraped_date", F.lit("/"), stem,
                    F.when(F.col("line_number") % 2 == 0, F.lit("_raw_")).otherwise(F.lit("_")), "scraped_date", F.lit(".csv"))
    return _quotes(spark, folder).select("order_key", "line_number", S.scraper_from_path(name).alias("scraper"))


# an unknown name ends at "_raw" or "_20"
oracle("scraper_names", """
SELECT order_key, line_number, CASE part_key % {n} {cases} ELSE
  'other_site' || CASE WHEN line_number % 2 = 0 OR scraped_date LIKE '20%' THEN '' ELSE '_' || scraped_date || '.csv' END END AS scraper
FROM quotes""".format(n=len(_FILE_STEMS), cases=" ".join(
    f"WHEN {i} THEN '{name}'" for i, (_, name) in enumerate(C.SOURCE_PREFIXES))), QUOTES)


@query
def captured_day(spark, folder):
    """Capture files in one folder a month; the folder of one month is read."""
    path, quotes = _folder(spark), _quotes(spark, folder)
    cells = quotes.withColumns({"base_fare": F.lit(None), "taxes_and_fees": F.lit(None), "departure_time": F.lit("10:30")})
    for month in ("1995-01", "1995-02"):
        tables.append_csv(cells.where(F.col("scraped_date").startswith(month)).select(
            *[F.col(c).cast("string").alias(c) for c in RAW_COLUMNS]), f"{path}/{month}")
    return captures.read_raw_quotes(spark, path, "1995-02").select("origin", "destination", "flight_num", "scraped_at")


oracle("captured_day", """
SELECT origin, destination, flight_num, scraped_at FROM quotes WHERE scraped_date LIKE '1995-02%'""", QUOTES)


@query
def composite_days_replaced(spark, folder):
    """The composite of all days stored, then its last year once more."""
    path = _folder(spark)
    composite = materialise(dc.daily_composite(_daily_flagged(spark, folder), W2), "composite")
    tables.replace_days(composite, path, "date", ["advance_purchase_days"])
    tables.replace_days(composite.where(F.col("date") >= "1998-01-01"), path, "date", ["advance_purchase_days"])
    return tables.read_table(spark, path)


oracle("composite_days_replaced", "SELECT * FROM day_composite", DAYS)


@query
def days_in_order(spark, folder):
    """Stored days, and how many rows stand before a row that should come first."""
    path = _folder(spark)
    tables.replace_days(_quotes(spark, folder).select("scraped_date", "route", "total_fare"), path, "scraped_date",
                        ["route", "total_fare"])
    stored = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("file"),
                                             F.col("_metadata.row_index").alias("at"))
    before = Window.partitionBy("file").orderBy("at")
    place = F.struct("route", "total_fare")
    return (stored.withColumn("late", F.lag(place).over(before) > place)
            .groupBy(F.col("scraped_date").cast("string").alias("scraped_date"))
            .agg(F.count("*").alias("n_rows"), F.count_if("late").alias("n_late")))


oracle("days_in_order", "SELECT scraped_date, count(*) AS n_rows, 0 AS n_late FROM quotes GROUP BY 1", QUOTES)


@query
def saved_pages(spark, folder):
    """Pages saved one to a file and read back."""
    path = _folder(spark)
    (star.table(spark, folder, "pages").select(F.coalesce("html", F.lit("")).alias("html"))
     .write.option("maxRecordsPerFile", 1).text(path))
    # the writer ends each record with a line break
    return captures.read_pages(spark, path, "*.txt").groupBy(
        F.md5(F.expr("left(html, length(html) - 1)")).alias("page")).agg(F.count("*").alias("n_files"))


oracle("saved_pages", "SELECT md5(coalesce(html, '')) AS page, count(*) AS n_files FROM pages GROUP BY 1")


@query
def empty_captures(spark, folder):
    """Capture files of all quotes beside an empty one: the empty one is a reject as a whole."""
    path = _folder(spark)
    quotes = _quotes(spark, folder)
    tables.append_csv(quotes.select(*[
        (F.col(c) if c in quotes.columns else F.lit(None)).cast("string").alias(c) for c in RAW_COLUMNS]), f"{path}/full")
    spark.createDataFrame([], "line string").write.csv(f"{path}/empty", header=False)
    rejects = captures.file_rejects(spark, path).select(F.regexp_extract("source_file", "/([a-z]+)/[^/]*$", 1).alias("place"), "raw_row")
    read = captures.read_raw_quotes(spark, path).agg(F.count("*").alias("n_rows"))
    return rejects.groupBy("place", "raw_row").agg(F.count("*").alias("n_files")).crossJoin(read)


oracle("empty_captures", """
SELECT 'empty' AS place, 'FILE_LEVEL' AS raw_row, 1 AS n_files, count(*) AS n_rows FROM quotes""", QUOTES)
