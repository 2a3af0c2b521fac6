"""The daily index kept up to date from counts of fares, one batch of quotes at a time.

State below a folder, all of it mergeable or replaced by whole days:

``fare_counts``  rows per (scraped_date, batch | route, carrier, horizon, weekday, fare), priced ok quotes only;
                 a batch adds its own files, and counts of all batches add up
``fare_limits``  per batch the median and reach of the groups that it touched; the newest row of a group holds
``index_days``   one row per date: composite fare, completeness, fare per route (a folder per date)
``index``        the published rows (a folder per date)

A batch changes the limits of the groups it has fares in, and with them the verdict on fares of earlier
days that lie between the old and the new limits.  Those days and the batch's own are *touched*: their
medians are taken again from ``fare_counts`` (their folders only), everything else stays as it is.
So the result is that of a full run, and a batch reads no earlier quotes at all.  Only a new first date,
or a change on it, rewrites the whole index (a row per date), because every value refers to it.

Batches are applied in the order of their names; applying the newest one again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..operators.order_stats import exact_median, exact_order_stats
from ..operators.outliers import MAD_KEYS
from ..session import materialise
from ..sources.tables import partition_values, read_table, replace_partitions, table_exists
from .fare_index import day_summary, route_days

DAY, BATCH = "scraped_date", "batch"
_COUNTED = [*MAD_KEYS, "day_of_week", "fare"]


def fare_counts(quotes: DataFrame) -> DataFrame:
    """Rows per date, group, weekday of travel and fare, of priced ok quotes with a date."""
    weekday = F.coalesce(F.weekday(F.col("travel_date").try_cast("date")), F.lit(0)).cast("int")
    priced = quotes.where((F.col("status") == "ok") & F.col("total_fare").isNotNull() & F.col(DAY).isNotNull())
    return (priced.groupBy(DAY, *MAD_KEYS, weekday.alias("day_of_week"), F.col("total_fare").alias("fare"))
            .agg(F.count("*").alias("n")))


def fare_limits(counts: DataFrame, threshold: float = C.MAD_THRESHOLD) -> DataFrame:
    """``MAD_KEYS``, median, reach of the groups that are large enough, from counts ``n`` of ``fare``."""
    values = counts.groupBy(*MAD_KEYS, "fare").agg(F.sum("n").alias("n"))
    centre = exact_median(values, MAD_KEYS, "fare", "median", weight="n")
    distance = (values.join(centre, MAD_KEYS)
                .select(*MAD_KEYS, "median", F.abs(F.col("fare") - F.col("median")).alias("_distance"), "n"))
    spread = exact_order_stats(distance, [*MAD_KEYS, "median"], "_distance", {"mad": 0.5}, weight="n")
    return spread.where(F.col("n_values") >= C.MAD_MIN_GROUP).select(
        *MAD_KEYS, "median", (threshold * F.greatest("mad", F.lit(C.MAD_FLOOR))).alias("reach"))


def is_far(median: str, reach: str):
    """The statistical verdict on ``fare``; a group without limits has no far fares."""
    gap = F.abs(F.col("fare") - F.col(median))
    return F.coalesce((gap > F.col(reach)) & (gap > C.MAD_MIN_DIFFERENCE), F.lit(False))


def limits_at(spark: SparkSession, store: str, batch: str, before: bool = False) -> DataFrame:
    """Limits that hold after ``batch`` (or before it): the newest row of every group."""
    path = f"{store}/fare_limits"
    if not table_exists(spark, path):
        return spark.createDataFrame([], "route string, carrier_code string, advance_purchase_days int, median double, reach double")
    rows = read_table(spark, path)
    rows = rows.where(F.col(BATCH) < batch if before else F.col(BATCH) <= batch)
    newest = rows.groupBy(*MAD_KEYS).agg(F.max(F.struct(BATCH, "median", "reach")).alias("l"))
    return newest.select(*MAD_KEYS, "l.median", "l.reach")


def counts_table(spark: SparkSession, store: str, days: list[str] | None = None) -> DataFrame:
    counts = read_table(spark, f"{store}/fare_counts")
    return counts if days is None else counts.where(F.col(DAY).isin(days))


def fold_counts(quotes: DataFrame, store: str, batch: str) -> list[str]:
    """Add a batch to ``fare_counts`` and ``fare_limits``; the days whose index it touches, in order."""
    spark = quotes.sparkSession
    path = f"{store}/fare_counts"
    if table_exists(spark, path):
        newest = max(partition_values(spark, f"{store}/fare_limits", BATCH), default=batch)
        if newest > batch:
            raise ValueError(f"batch {batch} comes after batch {newest}, which is applied already")
    own = materialise(fare_counts(quotes), "batch-counts")
    if own.isEmpty():
        return []
    replace_partitions(own.withColumn(BATCH, F.lit(batch)), path, [DAY, BATCH])

    groups = own.select(*MAD_KEYS).dropna().distinct()
    history = counts_table(spark, store).where(F.col(BATCH) <= batch).join(groups, MAD_KEYS, "left_semi")
    new = materialise(fare_limits(history), "limits")
    replace_partitions(new.withColumn(BATCH, F.lit(batch)), f"{store}/fare_limits", [BATCH])
    old = limits_at(spark, store, batch, before=True).withColumnsRenamed({"median": "_m", "reach": "_r"})
    moved = (new.join(old, MAD_KEYS, "left")
             .where(~(F.col("median").eqNullSafe(F.col("_m")) & F.col("reach").eqNullSafe(F.col("_r")))))
    turned = history.where(F.col(BATCH) < batch).join(moved, MAD_KEYS).where(
        is_far("median", "reach") != is_far("_m", "_r"))
    # one value a calendar day at most
    return sorted(row[0] for row in own.select(DAY).union(turned.select(DAY)).distinct().collect())


def day_rows(spark: SparkSession, store: str, days: list[str], batch: str, weights: dict[str, float],
             basket: list[str]) -> DataFrame:
    """``index_days`` rows of ``days``, from the folders of those days in ``fare_counts``."""
    counts = counts_table(spark, store, days).where(F.col(BATCH) <= batch)
    limited = counts.join(limits_at(spark, store, batch), MAD_KEYS, "left").where(~is_far("median", "reach"))
    medians = exact_median(limited, [DAY, "route", "advance_purchase_days"], "fare", "fare", weight="n")
    return day_summary(route_days(medians), weights, basket).withColumnRenamed(DAY, "date")


def published(rows: DataFrame, base: dict, basket: list[str]) -> DataFrame:
    """Index rows of ``index_days`` rows, against the base day's row."""

    def against(value, base_value):
        return value / F.lit(float(base_value)) * 100

    composite = base["composite_daily_fare"]
    headline = (S.rounded(against(F.col("composite_daily_fare"), composite), 2)
                if composite is not None and composite > 0 else F.lit(100.0))
    columns = []
    for route in basket:
        fare, at_base = F.col(f"`fare_{route}`"), base[f"fare_{route}"]
        ratio = S.rounded(against(fare, at_base), 2) if at_base else F.lit(None).cast("double")
        columns += [ratio.alias(f"index_{route}"), S.rounded(fare, 2).alias(f"fare_{route}")]
    return rows.select("date", headline.alias("composite_fare_index"), "composite_daily_fare", "data_completeness", *columns)


def update_index(quotes: DataFrame, store: str, batch: str, weights: dict[str, float] | None = None,
                 basket: list[str] | None = None) -> list[str]:
    """Apply a batch of quotes to the state in ``store``; the touched days."""
    spark = quotes.sparkSession
    weights, basket = C.WEIGHTS_V1 if weights is None else weights, basket or C.BASKET
    known = partition_values(spark, f"{store}/index_days", "date")
    days = fold_counts(quotes, store, batch)
    if not days:
        return []
    rows = materialise(day_rows(spark, store, days, batch, weights, basket), "touched-days")
    # a touched day all of whose fares are far now has no row any more: its folder is emptied
    gone = spark.createDataFrame([(d,) for d in days], "date string").join(rows.select("date"), "date", "left_anti")
    replace_partitions(rows, f"{store}/index_days", ["date"], empty=[r[0] for r in gone.collect()])
    table = read_table(spark, f"{store}/index_days")
    first = min(partition_values(spark, f"{store}/index_days", "date"))
    base = table.where(F.col("date") == first).first().asDict()
    if first in days or (known and first != known[0]):
        changed, gone_days = table, sorted(set(known) - set(partition_values(spark, f"{store}/index_days", "date")))
    else:
        changed, gone_days = rows, [r[0] for r in gone.collect()]
    replace_partitions(published(changed, base, basket), f"{store}/index", ["date"], empty=gone_days)
    return days


def current_index(spark: SparkSession, store: str) -> DataFrame:
    return read_table(spark, f"{store}/index")
