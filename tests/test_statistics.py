from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fareloom.operators import forest, outliers
from fareloom.operators.order_stats import (UPPER_MIDDLE, exact_order_stats,
                                            median_and_deviation)
from fareloom.operators.running import failure_runs, running_total
from fareloom.session import run_folder

from conftest import make_quotes


def _frame(spark, groups):
    rows = [(k, None if v is None else float(v)) for k, values in groups.items() for v in values]
    return spark.createDataFrame(rows, "k string, v double").repartition(5)


def test_order_stats_match_pandas_also_for_one_dominant_group(spark):
    rng = np.random.default_rng(3)
    groups = {
        "hot": list(np.round(rng.lognormal(8.5, 0.4, 6000), 2)),
        "same": [5000.0] * 500,
        "signs": list(rng.normal(0, 50, 301)) + [0.0, -0.0, 1e9, -1e9],
        "one": [42.0], "two": [1.0, 2.0], "holes": [None, 3.0, None, 1.0, 8.0, 9.0],
    }
    specs = {"q1": 0.25, "median": 0.5, "q3": 0.75, "middle": UPPER_MIDDLE}
    got = {r["k"]: r for r in exact_order_stats(_frame(spark, groups), ["k"], "v", specs).collect()}
    for key, values in groups.items():
        series = pd.Series(values, dtype=float).dropna().sort_values()
        row = got[key]
        assert row["n_values"] == len(series)
        for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
            assert row[name] == pytest.approx(series.quantile(p), rel=1e-12, abs=1e-9)
        assert row["middle"] == series.iloc[len(series) // 2]


def test_groups_without_values_or_keys_are_left_out(spark):
    frame = spark.createDataFrame([("a", None), (None, 1.0), ("b", 2.0)], "k string, v double")
    assert [r["k"] for r in exact_order_stats(frame, ["k"], "v", {"m": 0.5}).collect()] == ["b"]


def test_median_absolute_deviation(spark):
    row = median_and_deviation(_frame(spark, {"a": [10, 12, 11, 13, 100]}), ["k"], "v").first()
    assert (row["median"], row["mad"], row["n_values"]) == (12.0, 1.0, 5)


def test_mad_flags_the_planted_outlier_once(spark):
    rng = np.random.default_rng(42)
    fares = rng.normal(5000, 50, 60)
    fares[0] = 50000
    quotes = make_quotes(spark, [{"total_fare": float(f), "flight_num": f"6E {i}"}
                                 for i, f in enumerate(fares)])
    once = outliers.flag_mad(quotes)
    for result in (once, outliers.flag_mad(once)):
        rows = {r["flight_num"]: r for r in result.collect()}
        assert rows["6E 0"]["quality_flags"] == ["price_anomaly_statistical"]
        assert rows["6E 0"]["confidence_score"] == 0.75
        assert rows["6E 1"]["quality_flags"] == [] and rows["6E 1"]["confidence_score"] == 1.0


@pytest.mark.parametrize("fares, flagged", [([5000, 5000, 90000], False),
                                            ([5000, 5100, 5200, 5300, 90000], True)])
def test_iqr_needs_four_fares(spark, fares, flagged):
    quotes = make_quotes(spark, [{"total_fare": float(f)} for f in fares])
    marks = {r["total_fare"]: r["outlier_flag"] for r in outliers.flag_iqr(quotes).collect()}
    assert marks[90000.0] is flagged and not marks[5000.0]


def test_small_groups_use_the_history_of_the_route(spark):
    quotes = make_quotes(spark, [{"total_fare": 90000.0}, {"total_fare": None}])
    history = spark.createDataFrame([("DEL", "BOM", 8000.0)],
                                    "origin string, destination string, max_fare double")
    row = outliers.iqr_bounds(quotes, history_max=history).first()
    assert (row["lower_bound"], row["upper_bound"]) == (500.0, 80000.0)


def test_forest_ranks_the_planted_outlier_first_and_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [{"total_fare": float(f), "flight_num": f"6E {i}", "advance_purchase_days": 1 + 6 * (i % 2)}
            for i, f in enumerate(rng.normal(5000, 60, 80))]
    rows[7]["total_fare"] = 60000.0
    rows += [{"origin": "X", "flight_num": f"X {i}"} for i in range(49)]
    quotes = make_quotes(spark, rows)
    first = {r["flight_num"]: r for r in forest.flag_forest(quotes, trees=25).collect()}
    again = {r["flight_num"]: r["anomaly_score"]
             for r in forest.flag_forest(quotes, trees=25, part_rows=10).collect()}
    scores = {k: r["anomaly_score"] for k, r in first.items()}
    assert scores == again and len(first) == len(rows)
    ranked = sorted((k for k in scores if k.startswith("6E")), key=scores.get)
    assert ranked[-1] == "6E 7" and "price_anomaly_ml" in first["6E 7"]["quality_flags"]
    assert all(-0.5 <= s <= 0.5 for s in scores.values())
    assert all(scores[f"X {i}"] == 0.0 for i in range(49))


def test_failure_runs_cross_slice_borders(spark):
    events = [("a", f"2026-09-01 {h:02d}:30:00", h, h not in (3, 9)) for h in range(16)]
    events += [("b", "2026-09-01 00:00:00", i, i != 4) for i in range(9)]
    frame = spark.createDataFrame(events, "s string, t string, n int, bad boolean").withColumn(
        "t", F.col("t").cast("timestamp"))
    runs = failure_runs(frame, "s", "t", "n", F.col("bad"), 4).collect()
    assert sorted((r["s"], r["run_length"]) for r in runs) == [
        ("a", 5), ("a", 6), ("b", 4), ("b", 4)]


def test_running_total_spreads_one_group_with_one_time(spark):
    frame = spark.range(4000).select(F.lit("a").alias("s"), F.lit(5).alias("t"), F.col("id").alias("n"))
    rows = running_total(frame, ["s"], ["t", "n"], F.col("n") % 3, "total").select(
        "n", "total").orderBy("n").collect()
    assert [r["total"] for r in rows] == list(np.cumsum(np.arange(4000) % 3))
    parts = spark.read.parquet(max(Path(run_folder(spark)).glob("running-parts-*"), key=lambda p: p.stat().st_mtime).as_posix())
    assert parts.groupBy("_part").count().count() > 1


def test_limits_bounds_and_marks_meet_the_rows_without_a_shuffle(spark):
    from fareloom.operators import quality

    quotes = make_quotes(spark, [{"total_fare": 1000.0 + k, "flight_num": f"6E {k % 3}", "source_scraper": f"s{k % 2}"} for k in range(30)])
    stale = spark.createDataFrame([("s0", True), ("s1", False)], "source_scraper string, is_stale boolean")
    for frame in (outliers.flag_mad(quotes), outliers.flag_iqr(quotes), quality.quality_scores(quotes, stale),
                  outliers.attach_bounds(quotes, outliers.iqr_bounds(quotes))):
        assert frame.count() == 30
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_a_second_reading_shuffles_only_bands_with_a_wanted_rank(spark):
    rng = np.random.default_rng(5)
    groups = {"wide": list(np.round(rng.lognormal(8.5, 1.0, 8000), 2)), "same": [700.0] * 300, "signs": list(rng.normal(0, 50, 301)),
              "one": [42.0], "holes": [None, 3.0, None, 1.0], None: [5.0]}
    frame, specs = _frame(spark, groups), {"q1": 0.25, "m": 0.5, "middle": UPPER_MIDDLE}
    once, twice = (sorted(exact_order_stats(frame, ["k"], "v", specs, rescan=r).collect()) for r in (False, True))
    assert once == twice and len(once) == 5
    once, twice = (sorted(median_and_deviation(frame, ["k"], "v", rescan=r).collect()) for r in (False, True))
    assert once == twice
    exact_order_stats(frame, ["k"], "v", specs, rescan=True)
    bands = spark.read.parquet(max(Path(run_folder(spark)).glob("bands-*"), key=lambda p: p.stat().st_mtime).as_posix())
    assert bands.where("k = 'wide'").count() <= 2 * len(specs)
