"""Isolation forest per route (Liu, Ting and Zhou, 2008), repeatable in any engine.

Every choice is a hash: which trees a row enters, the column a node is cut on (in the order of the
columns open there) and the place of the cut are read off md5 texts of seed, route, tree and node.  So a
lost task, another partitioning or another engine grows the same trees.  Trees are a table of
(route, tree, node, column, cut, depth), the children of node k being 2 k and 2 k + 1.

A tree sees about 256 rows of its route, so a block of trees is a bounded group, grown level by level for
all its trees at once.  Scoring covers every distinct feature point; a route with very many points is cut
into parts that each meet their own copy of the route's trees.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..session import materialise
from .outliers import MAD_KEYS, group_features

FEATURES = ["advance_days", "day_of_week", "fare", "grp_mean", "grp_std"]
_POINT = ["route", "carrier_code", *FEATURES]
_NODES = "route string, tree int, node int, column string, cut double, depth double"
_SCORES = "route string, carrier_code string, advance_days double, day_of_week double, " \
          "fare double, grp_mean double, grp_std double, raw_score double"
_EULER = 0.5772156649015329
UNITS = 10_000  #: parts of a rupee in the text that names a point
BLOCK = 10  #: trees grown together


def mean_depth(n: int) -> float:
    """Average depth of an unsuccessful search in a binary tree over ``n`` rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (np.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n


def chance(text: str) -> float:
    """A number in [0, 1): the first 52 bits of the text's md5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2.0 ** 52


def chance_of(*parts) -> Column:
    """The same as a column expression, of the parts joined by bars."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(2.0 ** 52)


def grow(numbers: np.ndarray, carriers: np.ndarray, trees: np.ndarray, limit: int, seed: int, route: str) -> list[tuple]:
    """(tree, node, column, cut, depth) of all trees whose rows are given; a leaf has no column.

    ``numbers`` has the columns of ``FEATURES``; ``carriers`` are places in the sorted list of names, each
    a column of its own that parts the carrier (right) from the others (left).
    """
    out = []
    node = np.ones(len(trees), np.int64)
    alive = np.arange(len(trees))
    for level in range(limit + 1):
        if not len(alive):
            break
        order = alive[np.lexsort((node[alive], trees[alive]))]
        t, k, x, c = trees[order], node[order], numbers[order], carriers[order]
        starts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
        sizes = np.diff(np.r_[starts, len(t)])
        of = np.repeat(np.arange(len(starts)), sizes)
        low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
        present = np.zeros((len(starts), int(c.max()) + 1), bool)
        present[of, c] = True
        opened = np.hstack([high > low, present & (present.sum(1) > 1)[:, None]])
        count = opened.sum(1)
        column, cut = np.full(len(starts), -1), np.zeros(len(starts))
        splits = (sizes >= 2) & (count > 0) & (level < limit)
        for g in np.flatnonzero(splits):
            name = f"{route}|{t[starts[g]]}|{k[starts[g]]}"
            column[g] = np.flatnonzero(opened[g])[int(chance(f"{seed}|column|{name}") * count[g])]
            if column[g] < x.shape[1]:
                lo = low[g, column[g]]
                cut[g] = lo + (high[g, column[g]] - lo) * chance(f"{seed}|cut|{name}")
        for g in range(len(starts)):
            out.append((int(t[starts[g]]), int(k[starts[g]]), int(column[g]), float(cut[g]), level + mean_depth(int(sizes[g]))))
        mine = column[of]
        numeric = x[np.arange(len(x)), np.clip(mine, 0, x.shape[1] - 1)] > cut[of]
        right = np.where(mine < x.shape[1], numeric, c == mine - x.shape[1])
        node[order] = 2 * k + right
        alive = order[mine >= 0]
    return out


def _fit(seed: int, subsample: int):
    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        route, names = sample["route"].iloc[0], np.array(sorted(sample["carrier_code"].unique()), object)
        limit = int(np.ceil(np.log2(max(min(subsample, int(sample["_route_rows"].iloc[0])), 2))))
        nodes = grow(sample[FEATURES].to_numpy(float), np.searchsorted(names, sample["carrier_code"].to_numpy(object)),
                     sample["tree"].to_numpy(), limit, seed, route)
        labels = [*FEATURES, *(f"={name}" for name in names)]
        return pd.DataFrame([(route, t, k, labels[c] if c >= 0 else None, cut, depth) for t, k, c, cut, depth in nodes],
                            columns=["route", "tree", "node", "column", "cut", "depth"])
    return fit


def _score(subsample: int):
    def score(_key, points: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        if points.empty or forest.empty:
            return points.assign(raw_score=pd.Series(dtype=float))[[*_POINT, "raw_score"]]
        columns = {name: points[name].to_numpy(float) for name in FEATURES}
        carrier = points["carrier_code"].to_numpy(object)
        for name in {c for c in forest["column"].dropna() if c.startswith("=")}:
            columns[name] = (carrier == name[1:]).astype(float)  # right of the cut at 0
        names = list(columns)
        x = np.stack([columns[n] for n in names], 1)
        place = {n: i for i, n in enumerate(names)}
        total, rows = np.zeros(len(x)), np.arange(len(x))
        grown = forest.sort_values(["tree", "node"])
        for _, tree in grown.groupby("tree"):
            ids = tree["node"].to_numpy()
            column = np.array([place.get(c, -1) for c in tree["column"]])
            cut, depth = tree["cut"].to_numpy(), tree["depth"].to_numpy()
            left, right = np.searchsorted(ids, 2 * ids), np.searchsorted(ids, 2 * ids + 1)
            at = np.zeros(len(x), np.int64)
            moving = rows if column[0] >= 0 else rows[:0]
            while len(moving):
                here = at[moving]
                goes_right = x[moving, column[here]] > cut[here]
                at[moving] = here = np.where(goes_right, right[here], left[here])
                moving = moving[column[here] >= 0]
            total += depth[at]
        size = min(subsample, int(points["_route_rows"].iloc[0]))
        raw = np.power(2.0, -(total / grown["tree"].nunique()) / (mean_depth(size) or 1.0))
        return points.assign(raw_score=raw)[[*_POINT, "raw_score"]]
    return score


def forest_points(scored: DataFrame) -> DataFrame:
    """Priced ok rows with their features (``fare`` is the fare itself)."""
    rows = scored.where((F.col("status") == "ok") & F.col("total_fare").isNotNull())
    day = F.weekday(F.col("travel_date").try_cast("date"))
    features = materialise(group_features(scored), "features")  # a row per group: the rows need no shuffle
    return (rows.join(features, MAD_KEYS)
            .select("route", "carrier_code",
                    F.col("advance_purchase_days").cast("double").alias("advance_days"),
                    F.coalesce(day, F.lit(0)).cast("double").alias("day_of_week"),
                    F.col("total_fare").alias("fare"),
                    S.rounded(F.col("grp_mean"), 6).alias("grp_mean"), S.rounded(F.col("grp_std"), 6).alias("grp_std")))


def forest_scores(scored: DataFrame, min_rows: int = C.FOREST_MIN_ROWS,
                  trees: int = C.FOREST_TREES, subsample: int = C.FOREST_SUBSAMPLE,
                  seed: int = 42, part_rows: int = 200_000) -> DataFrame:
    """Distinct feature points of routes with enough rows, each with its ``raw_score``."""
    # written once: sizes, samples and scoring start from it
    points = materialise(forest_points(scored).groupBy(*_POINT).agg(F.count(F.lit(1)).alias("_copies")), "points")
    sizes = (points.groupBy("route")
             .agg(F.sum("_copies").alias("_route_rows"), F.count(F.lit(1)).alias("_route_points"))
             .where(F.col("_route_rows") >= min_rows))
    sized = points.join(sizes, "route")

    # A row is in a tree with the chance subsample / rows of the route (all trees of a small route): the
    # expected number of its trees, rounded by a hash, and as many neighbouring trees from a hashed start.
    units = F.round(F.col("fare") * UNITS).cast("long")
    row = ("route", "carrier_code", F.col("advance_days").cast("int"), F.col("day_of_week").cast("int"), units, "_copy")
    named = [c if isinstance(c, Column) else F.col(c) for c in row]
    expected = F.lit(float(trees)) * F.least(F.lit(1.0), F.lit(float(subsample)) / F.col("_route_rows"))
    rows = sized.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    entered = (rows.withColumn("_trees", F.floor(expected + chance_of(seed, "row", *named)).cast("int"))
               .where(F.col("_trees") > 0))
    start = F.floor(chance_of(seed, "start", *named) * trees).cast("int")
    samples = entered.select(*_POINT, "_route_rows", F.explode(F.transform(
        F.sequence(F.lit(0), F.least("_trees", F.lit(trees)) - 1), lambda k: F.pmod(start + k, F.lit(trees)))).alias("tree"))
    # a fixed number of partitions: fitting is heavy per row, so few rows must still spread out
    tasks = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.floor(F.col("tree") / BLOCK).alias("_block")
    forest = (samples.withColumn("_block", block).repartition(tasks, "route", "_block").groupBy("route", "_block")
              .applyInPandas(_fit(seed, subsample), _NODES))

    parts = F.ceil(F.col("_route_points") / F.lit(part_rows)).cast("int")
    cut = sized.withColumn("_part", F.pmod(F.xxhash64(*_POINT), parts).cast("int"))
    copies_of_trees = (forest.join(sizes.select("route", parts.alias("_parts")), "route")
                       .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
                       .drop("_parts"))
    place = ["route", "_part"]
    return (cut.repartition(tasks, *place).groupBy(*place)
            .cogroup(copies_of_trees.repartition(tasks, *place).groupBy(*place))
            .applyInPandas(_score(subsample), _SCORES))


def flag_forest(scored: DataFrame, **options) -> DataFrame:
    """Add ``anomaly_score`` (0 where no model applies) and the model's flag."""
    found = forest_scores(scored, **options)
    day = F.coalesce(F.weekday(F.col("travel_date").try_cast("date")), F.lit(0))
    keyed = (scored.withColumn("advance_days", F.col("advance_purchase_days").cast("double"))
             .withColumn("day_of_week", day.cast("double"))
             .withColumn("fare", F.when(F.col("status") == "ok", F.col("total_fare"))))
    # mean and spread follow from route, carrier and horizon, so these keys name one point
    keys = ["route", "carrier_code", "advance_days", "day_of_week", "fare"]
    best = found.select(*keys, F.col("raw_score").alias("_raw"))
    odd = F.coalesce(F.col("_raw") > 0.5, F.lit(False))
    return (keyed.join(best, keys, "left")
            .withColumn("anomaly_score", F.coalesce(S.rounded(F.col("_raw") - 0.5, 4), F.lit(0.0)))
            .withColumn("quality_flags", F.when(odd, F.array_union(
                "quality_flags", F.array(F.lit(C.FLAG_MODEL)))).otherwise(F.col("quality_flags")))
            .drop("advance_days", "day_of_week", "fare", "_raw"))
