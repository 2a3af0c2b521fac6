"""Short forecasts: linear trend plus weekday pattern, fitted with SQL aggregates.

Every quantity of the model is a sum over the points of a target: moments per target and weekday give
trend, season and spread in closed form, so the series is read once and any number of targets is
fitted in parallel.  What is held per target are its calendar days and seven weekdays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..schema import FORECAST


def long_series(index: DataFrame) -> DataFrame:
    """Wide daily index to ``ds, target, y, completeness``."""
    targets = [c for c in index.columns if c == "composite_fare_index" or c.startswith("index_")]
    return (index.select(F.col("date").alias("ds"),
                         F.col("data_completeness").alias("completeness"), *targets)
            .unpivot(["ds", "completeness"], targets, "target", "y"))


def empty_forecast(spark) -> DataFrame:
    return spark.createDataFrame([], FORECAST)


def forecast_series(series: DataFrame, days: int = C.FORECAST_DAYS,
                    min_days: int = C.FORECAST_MIN_DAYS) -> DataFrame:
    """Fitted and future values per target with an 80 % band and a confidence.

    ``series`` has ``ds`` (text date), ``target``, ``y`` and ``completeness``.  Nothing is
    returned while the table as a whole, or the target, has too few days; one target's
    failure never affects another.
    """
    origin = F.lit("1970-01-01").cast("date")
    day = F.col("ds").try_cast("date")
    y = F.when(day.isNotNull(), F.col("y"))
    daily = (series.groupBy("target", "ds")
             .agg(F.count(y).alias("_n"), F.sum(y).alias("_y"), F.sum(y * y).alias("_yy"),
                  F.max("completeness").alias("completeness")))
    overall = daily.agg(F.countDistinct("ds").alias("n_days"), F.max_by("completeness", "ds").alias("last_completeness"))
    t = F.datediff("_day", origin).cast("double")
    points = daily.where("_n > 0").withColumn("_day", day).withColumn("_t", t)

    sums = [F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_t")).alias("t"), F.sum("_y").alias("y"),
            F.sum(F.col("_n") * F.col("_t") * F.col("_t")).alias("tt"), F.sum(F.col("_t") * F.col("_y")).alias("ty"),
            F.sum("_yy").alias("yy"), F.collect_set("_day").alias("days"), F.count_distinct("ds").alias("n_days")]
    weekly = points.groupBy("target", F.weekday("_day").alias("weekday")).agg(*sums)
    fields = ["n", "t", "y", "tt", "ty", "yy"]
    totals = (weekly.groupBy("target")
              .agg(*[F.sum(c).alias(c) for c in fields], F.sum("n_days").alias("n_days"),
                   F.flatten(F.collect_list("days")).alias("days"),
                   F.array_sort(F.collect_list(F.struct("weekday", "n", "t", "y"))).alias("weeks"))
              .where(F.col("n_days") >= min_days))
    mean_t, mean_y = F.col("t") / F.col("n"), F.col("y") / F.col("n")
    spread_t = F.col("tt") - F.col("t") * mean_t
    trend = totals.withColumns({
        "_mean_t": mean_t, "_mean_y": mean_y,
        "_slope": (F.col("ty") - F.col("t") * mean_y) / F.when(spread_t > 0, spread_t)})
    trend = trend.withColumn("_seasons", F.transform("weeks", lambda w: F.struct(
        w["weekday"].alias("weekday"), w["n"].alias("n"),
        (w["y"] / w["n"] - F.col("_mean_y") - F.col("_slope") * (w["t"] / w["n"] - F.col("_mean_t"))).alias("s"))))
    # squared rests are what trend and season leave of the squared distances from the mean
    rest = (F.col("yy") - F.col("y") * F.col("_mean_y") - F.col("_slope") * (F.col("ty") - F.col("t") * F.col("_mean_y"))
            - F.aggregate("_seasons", F.lit(0.0), lambda a, w: a + w["n"] * w["s"] * w["s"]))
    trend = trend.withColumns({"_sigma": F.sqrt(F.greatest(F.lit(0.0), rest) / F.col("n")), "_last": F.array_max("days")})
    future = F.sequence(F.date_add("_last", 1), F.date_add("_last", days))
    calendar = F.concat(F.transform(F.array_distinct("days"), lambda d: F.struct(d.alias("_day"), F.lit(False).alias("is_forecast"))),
                        F.transform(future, lambda d: F.struct(d.alias("_day"), F.lit(True).alias("is_forecast"))))
    season = F.get(F.filter("_seasons", lambda w: w["weekday"] == F.weekday("_day")), F.lit(0))["s"]
    line = F.col("_mean_y") + F.col("_slope") * (t - F.col("_mean_t"))
    fitted = (trend.select("target", "_mean_t", "_mean_y", "_slope", "_seasons", "_sigma", F.inline(calendar))
              .withColumn("_yhat", line + F.coalesce(season, F.lit(0.0)))
              .withColumn("_half", F.lit(C.FORECAST_Z80) * F.col("_sigma")))
    certainty = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 2 * F.col("_half") / F.greatest(
        F.abs("_yhat"), F.lit(1.0))))
    last = overall.select("last_completeness").scalar()
    enough = overall.select("n_days").scalar() >= min_days
    return fitted.where(enough).select(
        F.date_format("_day", "yyyy-MM-dd").alias("ds"), "target",
        S.rounded(F.col("_yhat"), 2).alias("yhat"),
        S.rounded(F.col("_yhat") - F.col("_half"), 2).alias("yhat_lower"),
        S.rounded(F.col("_yhat") + F.col("_half"), 2).alias("yhat_upper"),
        S.rounded(certainty * F.coalesce(last, F.lit(1.0)), 4).alias("forecast_confidence"),
        "is_forecast")


def forecast_index(index: DataFrame, **options) -> DataFrame:
    """Forecast of the composite and of every route index of a daily index table."""
    return forecast_series(long_series(index), **options)
