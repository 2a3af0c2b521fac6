"""Exact medians, quantiles and order statistics for groups of any size.

``percentile`` keeps every distinct value of a group in one buffer.  Here a group is cut
into value bands instead, so that even a group holding a third of all rows is worked on
by many tasks:

1. count rows per (group, band, value); the counts are combined before the shuffle;
2. a running total over the few bands of a group tells which band holds each wanted rank;
3. only those bands are ordered by value to read the wanted values off.

A band is a fixed range on a logarithmic scale, so its number per group is bounded by the
width of the double range and not by the number of rows.

``rescan`` is for stored rows that are cheap to read: bands are counted in a first reading, and
in a second one only values of the bands that hold a wanted rank are shuffled, a few in a hundred.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

UPPER_MIDDLE = "upper_middle"
_BANDS_PER_UNIT = 32


def value_band(value: Column) -> Column:
    """Order-keeping band number: about 3 % wide for large values."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * _BANDS_PER_UNIT)


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows per distinct value of each group; null keys and null values are left out."""
    return (df.dropna(subset=[*keys, value]).groupBy(*keys, value)
            .agg(F.count(F.lit(1)).alias("n")))


def _ranks(stat, total: Column) -> tuple[Column, Column, Column]:
    """Zero-based ranks to read and the share of the upper one."""
    if stat == UPPER_MIDDLE:
        middle = F.floor(total / 2)
        return middle, middle, F.lit(0.0)
    place = F.lit(float(stat)) * (total - 1)
    return F.floor(place), F.ceil(place), place - F.floor(place)


def exact_order_stats(df: DataFrame, keys: list[str], value: str, stats: dict,
                      weight: str | None = None, rescan: bool = False) -> DataFrame:
    """One row per group: ``keys``, ``n_values`` and one column per entry of ``stats``.

    ``stats`` maps an output name to a probability (interpolated linearly, as pandas and
    ``percentile`` do) or to ``UPPER_MIDDLE`` (element floor(n/2) of the sorted values).
    ``weight`` names a column with the multiplicity of each row.
    ``rescan`` reads ``df`` two times, the first time at once, and shuffles few of its values.
    """
    rows = (df.dropna(subset=[*keys, value]).withColumn("_band", value_band(F.col(value)))
            .where(F.col("_band").isNotNull()))
    many = F.sum(weight) if weight else F.count(F.lit(1))
    if not rescan:
        counts = rows.groupBy(*keys, "_band", value).agg(many.alias("_n"))

    group = Window.partitionBy(*keys)
    sizes = (rows.groupBy(*keys, "_band").agg(many.alias("_band_n")) if rescan
             else counts.groupBy(*keys, "_band").agg(F.sum("_n").alias("_band_n")))
    bands = (sizes
             .withColumn("_upto", F.sum("_band_n").over(
                 group.orderBy("_band").rowsBetween(Window.unboundedPreceding, 0)))
             .withColumn("_total", F.sum("_band_n").over(group))
             .withColumn("_before", F.col("_upto") - F.col("_band_n")))

    def inside(rank: Column, start: Column, count: Column) -> Column:
        return (rank >= start) & (rank < start + count)

    wanted = []
    for stat in stats.values():
        low, high, _ = _ranks(stat, F.col("_total"))
        wanted += [inside(low, F.col("_before"), F.col("_band_n")),
                   inside(high, F.col("_before"), F.col("_band_n"))]
    targets = (bands.where(reduce(lambda a, b: a | b, wanted))
               .select(*keys, "_band", "_before", "_total"))
    if rescan:
        targets = materialise(targets, "bands")
        counts = rows.join(targets.select(*keys, "_band"), [*keys, "_band"]).groupBy(*keys, "_band", value).agg(many.alias("_n"))

    in_band = Window.partitionBy(*keys, "_band").orderBy(value)
    placed = (counts.join(targets, [*keys, "_band"])
              .withColumn("_upto", F.sum("_n").over(
                  in_band.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("_start", F.col("_before") + F.col("_upto") - F.col("_n")))

    picks = [F.max("_total").alias("n_values")]
    for name, stat in stats.items():
        low, high, _ = _ranks(stat, F.col("_total"))
        for part, rank in (("lo", low), ("hi", high)):
            hit = inside(rank, F.col("_start"), F.col("_n"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{part}_{name}"))
    read = placed.groupBy(*keys).agg(*picks)

    out = [*keys, "n_values"]
    for name, stat in stats.items():
        share = _ranks(stat, F.col("n_values"))[2]
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low * (1 - share) + high * share).alias(name))
    return read.select(*out)


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median",
                 weight: str | None = None, rescan: bool = False) -> DataFrame:
    return exact_order_stats(df, keys, value, {name: 0.5}, weight, rescan).drop("n_values")


def median_and_deviation(df: DataFrame, keys: list[str], value: str, rescan: bool = False) -> DataFrame:
    """``keys, n_values, median, mad``: the median and the median distance from it.

    The value counts have one shuffle, which both steps use, so the rows are read one time; with ``rescan``
    they are read four times instead, and few values are shuffled.
    """
    if rescan:
        centre = materialise(exact_median(df, keys, value, rescan=True), "medians")
        distance = df.join(centre, keys).select(*keys, "median", F.abs(F.col(value) - F.col("median")).alias("_distance"))
        return exact_order_stats(distance, [*keys, "median"], "_distance", {"mad": 0.5}, rescan=True)
    # the filter that the order statistics set as well, so that both steps have the same plan below the shuffle
    counts = value_counts(df.where(value_band(F.col(value)).isNotNull()), keys, value)
    centre = exact_median(counts, keys, value, "median", weight="n")
    distance = (counts.join(centre, keys)
                .select(*keys, "median", F.abs(F.col(value) - F.col("median")).alias("_distance"),
                        "n"))
    return exact_order_stats(distance, [*keys, "median"], "_distance", {"mad": 0.5}, weight="n")
