"""Statistical outliers: median absolute deviation and inter-quartile range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..session import materialise
from .order_stats import exact_order_stats, median_and_deviation

MAD_KEYS = ["route", "carrier_code", "advance_purchase_days"]
IQR_KEYS = ["origin", "destination", "advance_purchase_days"]


def _priced_ok(quotes: DataFrame) -> DataFrame:
    return quotes.where((F.col("status") == "ok") & F.col("total_fare").isNotNull())


def mad_table(quotes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, n_values, median, mad`` over priced ok quotes."""
    return median_and_deviation(_priced_ok(quotes), list(keys or MAD_KEYS), "total_fare", rescan=True)


def flag_mad(scored: DataFrame, threshold: float = C.MAD_THRESHOLD,
             keys: list[str] | None = None, limits: DataFrame | None = None) -> DataFrame:
    """Flag fares far from their group's median and lower their confidence.

    ``limits`` (keys, median, reach) stands in for those of ``scored`` itself, where only some days are given.

    The confidence before this step is kept in ``base_confidence`` and used whenever it is
    there, so running the step on its own output changes nothing.  The limits are written out before
    they meet the rows: their size is known then, and a small table needs no shuffle of the rows.
    """
    keys = list(keys or MAD_KEYS)
    if limits is None:
        limits = (mad_table(scored, keys).where(F.col("n_values") >= C.MAD_MIN_GROUP)
                  .withColumn("reach", threshold * F.greatest("mad", F.lit(C.MAD_FLOOR))))
    limit = materialise(limits.select(*keys, F.col("median").alias("_median"), F.col("reach").alias("_reach")), "limits")
    gap = F.abs(F.col("total_fare") - F.col("_median"))
    is_far = F.coalesce((F.col("status") == "ok") & (gap > F.col("_reach"))
                        & (gap > C.MAD_MIN_DIFFERENCE), F.lit(False))
    has_base = "base_confidence" in scored.columns
    base = F.col("base_confidence") if has_base else F.col("confidence_score")
    lowered = S.rounded(F.greatest(F.lit(0.0), base - C.PENALTY_STATISTICAL), 4)
    flags = F.coalesce("quality_flags", F.array().cast("array<string>"))
    cleared = F.array_remove(flags, C.FLAG_STATISTICAL) if has_base else flags
    return (scored.join(limit, keys, "left")
            .withColumn("_far", is_far)
            .withColumn("base_confidence", base)
            .withColumn("confidence_score", F.when(F.col("_far"), lowered).otherwise(
                S.rounded(base, 4)))
            .withColumn("quality_flags", F.when(
                F.col("_far"), F.array_union(flags, F.array(F.lit(C.FLAG_STATISTICAL))))
                .otherwise(cleared))
            .drop("_median", "_reach", "_far"))


def iqr_bounds(quotes: DataFrame, keys: list[str] | None = None,
               history_max: DataFrame | None = None) -> DataFrame:
    """``keys, lower_bound, upper_bound`` of the groups with a priced ok row.

    Groups of fewer than four fares have no quartiles worth using: they get the fixed lower
    bound and ten times the route's highest accepted fare so far (``history_max`` with
    ``origin, destination, max_fare``), or ten times a default for a new route.
    """
    keys = list(keys or IQR_KEYS)
    stats = exact_order_stats(_priced_ok(quotes), keys, "total_fare", {"q1": 0.25, "q3": 0.75}, rescan=True)
    if history_max is None:
        stats = stats.withColumn("max_fare", F.lit(None).cast("double"))
    else:
        stats = stats.join(history_max, ["origin", "destination"], "left")
    small = F.col("n_values") < C.IQR_MIN_GROUP
    reach = C.IQR_FACTOR * (F.col("q3") - F.col("q1"))
    upper = F.col("q3") + reach
    fallback = C.FALLBACK_FACTOR * F.coalesce("max_fare", F.lit(C.FALLBACK_HISTORY_MAX))
    return stats.select(
        *keys,
        F.when(small, F.lit(C.IQR_FLOOR)).otherwise(
            F.least(F.col("q1") - reach, F.lit(C.IQR_FLOOR))).alias("lower_bound"),
        F.when(small | (upper == -1), fallback).otherwise(upper).alias("upper_bound"))


def attach_bounds(quotes: DataFrame, bounds: DataFrame, keys: list[str] | None = None
                  ) -> DataFrame:
    """Each quote with its bounds, which are written out first, as the limits of :func:`flag_mad`."""
    return quotes.join(materialise(bounds, "bounds"), list(keys or IQR_KEYS), "left")


def flag_iqr(quotes: DataFrame, keys: list[str] | None = None,
             history_max: DataFrame | None = None) -> DataFrame:
    """Add ``outlier_flag``; every row stays, rows that are not ok are never flagged."""
    keys = list(keys or IQR_KEYS)
    fare = F.col("total_fare")
    outside = (F.col("status") == "ok") & ((fare < F.col("lower_bound"))
                                           | (fare > F.col("upper_bound")))
    return (attach_bounds(quotes, iqr_bounds(quotes, keys, history_max), keys)
            .withColumn("outlier_flag", F.coalesce(outside, F.lit(False)))
            .drop("lower_bound", "upper_bound"))


def history_maximum(flagged: DataFrame) -> DataFrame:
    """Highest fare per route that was not an outlier."""
    return (flagged.where(~F.col("outlier_flag")).groupBy("origin", "destination")
            .agg(F.max("total_fare").alias("max_fare")))


def group_features(quotes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, grp_mean, grp_std`` of priced ok fares; one single fare has spread 0.

    Sums are taken over whole ten-thousandths, so they do not depend on the order of the rows.
    """
    keys = list(keys or MAD_KEYS)
    units = F.round(F.col("total_fare") * 10_000).cast("decimal(18,0)")
    sums = (_priced_ok(quotes).dropna(subset=keys).groupBy(*keys)
            .agg(F.count(F.lit(1)).cast("decimal(18,0)").alias("_n"), F.sum(units).cast("decimal(28,0)").alias("_s"),
                 F.sum((units * units).cast("decimal(38,0)")).alias("_q")))
    squares = (F.col("_n") * F.col("_q") - F.col("_s") * F.col("_s")).cast("double")
    n = F.col("_n").cast("double")
    return sums.select(*keys, (F.col("_s").cast("double") / n / 10_000).alias("grp_mean"),
                       F.when(n > 1, F.sqrt(squares / (n * (n - 1))) / 10_000).otherwise(F.lit(0.0)).alias("grp_std"))
