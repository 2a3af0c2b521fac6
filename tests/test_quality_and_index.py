import itertools
import re

import pytest

from fareloom.operators import dedup, filters, forecast, quality
from fareloom.operators.coverage import coverage_gaps
from fareloom.plans import daily_composite as dc
from fareloom.plans import fare_index as fi
from fareloom.plans import products
from fareloom.sources.tables import read_table

from conftest import make_quotes


def _index_rows():
    rows = []
    for day, fare in (("2026-09-01", 5000.0), ("2026-09-02", 6000.0)):
        for (a, b), horizon in itertools.product((("DEL", "BOM"), ("DEL", "BLR")), (1, 7, 15)):
            rows.append({"origin": a, "destination": b, "advance_purchase_days": horizon,
                         "total_fare": fare, "scraped_at": f"{day}T10:00:00+05:30"})
    rows.append({"status": "no_flights", "total_fare": None})
    rows.append({"total_fare": 50000.0, "quality_flags": ["price_anomaly_statistical"]})
    return rows


def test_index_and_audit(spark):
    quotes = make_quotes(spark, _index_rows())
    days = fi.fare_index_daily(quotes).orderBy("date").collect()
    assert [r["composite_fare_index"] for r in days] == [100.0, 120.0]
    assert [r["composite_daily_fare"] for r in days] == [5000.0, 6000.0]
    assert [r["data_completeness"] for r in days] == [0.2, 0.2]
    assert days[1]["index_DEL-BOM"] == 120.0 and days[1]["index_MAA-DEL"] is None
    reasons = sorted(r["exclusion_reason"] for r in filters.excluded_audit(quotes).collect())
    assert reasons == ["price_anomaly_statistical", "status_not_ok (no_flights); null_total_fare"]


def test_custom_weights_base_date_and_late_route(spark):
    rows = [{"total_fare": 4000.0}, {"origin": "MAA", "destination": "DEL", "total_fare": 9000.0,
                                     "scraped_at": "2026-09-02T10:00:00+05:30"},
            {"total_fare": 6000.0, "scraped_at": "2026-09-02T10:00:00+05:30"}]
    quotes = make_quotes(spark, rows)
    days = fi.fare_index_daily(quotes, {"DEL-BOM": 0.5, "MAA-DEL": 1.0}).orderBy("date").collect()
    assert [r["composite_daily_fare"] for r in days] == [4000.0, 8000.0]
    assert days[1]["index_MAA-DEL"] is None and days[1]["index_DEL-BOM"] == 150.0
    rebased = fi.fare_index_daily(quotes, {}, base_date="2026-09-02").orderBy("date").collect()
    assert [r["composite_fare_index"] for r in rebased] == [53.33, 100.0]


def _score(spark, rows, stale=None):
    return quality.quality_scores(
        make_quotes(spark, rows).drop("quality_flags", "confidence_score"), stale).collect()


@pytest.mark.parametrize("change, score, flags", [
    ({}, 1.0, []),
    ({"data_source_method": "llm_fallback"}, 0.70, ["llm_sourced"]),
    ({"fare_split_estimated": True}, 0.85, ["fare_estimated"]),
    ({"total_fare": None}, 0.50, ["missing_price"]),
    ({"source_scraper": "akasa"}, 0.80, ["stale_selector"]),
])
def test_each_rule(spark, change, score, flags):
    verified = spark.createDataFrame(
        [("indigo", "2026-09-01T07:00:00", True), ("akasa", "2026-08-10T07:00:00", True)],
        "site string, last_verified_at string, active boolean")
    stale = quality.stale_sources(quality.oldest_verified(verified), "2026-09-02T07:00:00+05:30")
    row = _score(spark, [change], stale)[0]
    assert (row["confidence_score"], row["quality_flags"]) == (score, flags)


def test_cross_source_confirmation(spark):
    rows = _score(spark, [
        {"total_fare": 5000.0, "fare_split_estimated": True},
        {"total_fare": 5100.0, "source_scraper": "goibibo", "data_source_method": "llm_fallback",
         "fare_split_estimated": False},
        {"status": "sold_out", "total_fare": None, "source_scraper": "akasa"}])
    assert sorted(r["confidence_score"] for r in rows) == [0.8, 0.95, 1.0]
    assert all("cross_source_confirmed" in r["quality_flags"] for r in rows)


def test_confirmed_keys_equal_the_pairwise_definition(spark):
    import random
    random.seed(5)
    rows = [{"flight_num": f"6E {random.randrange(25)}", "source_scraper": random.choice("abc"),
             "total_fare": random.choice([0.0, 98.0, 100.0, 102.0, 102.05, random.uniform(50, 400)])}
            for _ in range(160)]
    pairs = {a["flight_num"] for a, b in itertools.combinations(rows, 2)
             if a["flight_num"] == b["flight_num"] and a["source_scraper"] != b["source_scraper"]
             and a["total_fare"] and b["total_fare"] and abs(a["total_fare"] - b["total_fare"])
             / max(a["total_fare"], b["total_fare"]) <= 0.02}
    found = quality.confirmed_keys(make_quotes(spark, rows)).collect()
    assert {r["flight_num"] for r in found} == pairs and len(found) == len(pairs)


def test_keep_latest_compares_instants_not_texts(spark):
    quotes = make_quotes(spark, [
        {"scraped_at": "2026-09-01T10:00:00+05:30", "total_fare": 1.0},
        {"scraped_at": "2026-09-01T06:00:00+00:00", "total_fare": 2.0},
        {"scraped_at": "2026-09-01T05:00:00+00:00", "total_fare": 3.0, "source": "ota"}])
    assert [r["total_fare"] for r in dedup.keep_latest(quotes).collect()] == [2.0]
    both = dedup.keep_latest(quotes, keep_sources=True).collect()
    assert sorted(r["total_fare"] for r in both) == [2.0, 3.0]


def test_append_keeps_copies_inside_the_batch_and_matches_missing_keys(spark):
    master = make_quotes(spark, [{"flight_num": None}, {"flight_num": "A"}])
    batch = make_quotes(spark, [{"flight_num": None}, {"flight_num": "B"}, {"flight_num": "B"}])
    assert [r["flight_num"] for r in dedup.append_new(master, batch).collect()] == ["B", "B"]


def test_coverage_gaps(spark):
    routes = [("DEL", c) for c in "ABCDEF"]
    rows = [{"origin": a, "destination": b, "advance_purchase_days": h, "status": "no_flights"}
            for a, b in routes for h in (1, 7)]
    rows += [{"origin": a, "destination": b, "advance_purchase_days": 15, "status": "parse_error"}
             for a, b in routes]
    gaps = coverage_gaps(make_quotes(spark, rows), status="status").collect()
    assert sorted(r["advance_purchase_days"] for r in gaps) == [15, 30, 45]


def _history(spark, n):
    days = [(f"2026-08-{d:02d}", 100.0 + d, 90.0 + (d % 7), 0.8) for d in range(1, n + 1)]
    return spark.createDataFrame(
        days, "date string, composite_fare_index double, `index_DEL-BOM` double, "
              "data_completeness double")


def test_forecast_needs_fourteen_days(spark):
    short = forecast.forecast_index(_history(spark, 3))
    assert short.columns == forecast.empty_forecast(spark).columns and short.count() == 0


def test_forecast_shape_and_confidence(spark):
    rows = forecast.forecast_index(_history(spark, 15), days=3).collect()
    assert len(rows) == 36 and sum(r["is_forecast"] for r in rows) == 6
    assert all(0 <= r["forecast_confidence"] <= 1 for r in rows)
    line = [r for r in rows if r["target"] == "composite_fare_index" and r["is_forecast"]]
    assert sorted(r["yhat"] for r in line) == [116.0, 117.0, 118.0]


def test_trajectory_fills_gaps_and_signal(spark):
    quotes = make_quotes(spark, [{"advance_purchase_days": 7, "total_fare": f}
                                 for f in (4000.0, 5000.0, 6000.0, 7000.0)])
    from pyspark.sql import functions as F
    flagged = quotes.withColumn("outlier_flag", F.lit(False))
    path = products.route_trajectory(flagged)
    values = {r["window"]: (r["value"], r["is_interpolated"]) for r in path.collect()}
    assert values == {"T+1": (7200.0, True), "T+7": (6000.0, False), "T+15": (5400.0, True),
                      "T+30": (5400.0, True), "T+45": (5400.0, True)}
    base = products.seasonal_baseline(flagged)
    assert base.first()["baseline"] == 5500.0
    assert products.book_or_wait(path, base, 7).first()["signal"] == "RED"


def test_day_run_is_idempotent(spark, tmp_path):
    rows = [{"total_fare": f, "flight_num": f"6E {i}", "source": s}
            for i, f in enumerate((4000.0, 5000.0, 5200.0, 5400.0)) for s in ("ota", "airline_direct")]
    rows += [{**r, "scraped_at": "2026-09-02T10:00:00+05:30"} for r in rows]
    quotes, index, composite = make_quotes(spark, rows), f"{tmp_path}/index", f"{tmp_path}/composite"
    for day in ("2026-09-01", "2026-09-02", "2026-09-02"):
        dc.run_day(quotes, day, index, composite, keep_sources=True)
    stored = read_table(spark, index)
    assert stored.count() == 16
    days = read_table(spark, composite).orderBy("date").collect()
    assert [(r["date"], r["composite_score"], r["ota_premium_pct"]) for r in days] == [
        ("2026-09-01", 5100.0, 0.0), ("2026-09-02", 5100.0, 0.0)]


def _tables(spark, folder, lines=400):
    """A small star schema: every order has its customer, every line item its order and its supplier."""
    from fareloom.sources.star import LAYOUTS

    number = "CAST(id AS INT)"
    made = {
        "region": (5, f"{number} AS r_regionkey, concat('R', id) AS r_name"),
        "nation": (25, f"{number} AS n_nationkey, concat('N', id) AS n_name, CAST(id % 5 AS INT) AS n_regionkey"),
        "customer": (30, "id AS c_custkey, 'c' AS c_name, CAST(id % 25 AS INT) AS c_nationkey, 0D AS c_acctbal, concat('SEG', id % 3) AS c_mktsegment"),
        "supplier": (10, "id AS s_suppkey, 's' AS s_name, CAST(id % 25 AS INT) AS s_nationkey, 0D AS s_acctbal"),
        "orders": (100, "id AS o_orderkey, id % 30 AS o_custkey, 'F' AS o_orderstatus, 1D AS o_totalprice, "
                        "TIMESTAMP_NTZ'1995-01-05' + make_dt_interval(id) AS o_orderdate, concat(id % 5, '-P') AS o_orderpriority"),
        "lineitem": (lines, "id % 100 AS l_orderkey, id AS l_partkey, id % 10 AS l_suppkey, CAST(id % 7 + 1 AS INT) AS l_linenumber, "
                            "CAST(id % 50 AS DOUBLE) AS l_quantity, 1000D + id AS l_extendedprice, 0D AS l_discount, 0D AS l_tax, "
                            "'N' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP_NTZ'1995-03-05' AS l_shipdate")}
    for name, (rows, columns) in made.items():
        spark.range(rows).createOrReplaceTempView("ids")
        frame = spark.sql(f"SELECT {columns} FROM ids")
        assert [f.name for f in frame.schema] == [c.split()[0] for c in LAYOUTS[name].split(", ")]
        frame.write.parquet(f"{folder}/{name}.parquet")


def test_line_items_move_once_with_the_columns_that_are_read(spark, tmp_path):
    from fareloom.catalog import queries
    from fareloom.sources import star

    folder = str(tmp_path)
    _tables(spark, folder)
    narrow = star.fare_quotes(spark, folder).select("route", "status", "total_fare")
    assert narrow.count() == 400
    plan = narrow._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "hashpartitioning(l_suppkey" not in plan and "l_shipdate" not in plan
    index = queries.QUERIES["fare_index_daily"](spark, folder).collect()
    stored = queries._STAGES[queries._key(spark, folder, "quotes:advance_purchase_days,carrier_code,route,scraped_date,status,total_fare")]
    assert stored.count() == 400 and len(index) == 4
    assert queries._key(spark, folder, "quotes") not in queries._STAGES


def test_more_line_items_take_more_tasks(spark, tmp_path, monkeypatch):
    """The rows that one task sorts are bounded, whatever number of shuffle partitions is set."""
    from fareloom.sources import star

    _tables(spark, str(tmp_path))
    dealt = r"hashpartitioning\(l_orderkey#\d+L, (\d+)\)"
    for most, tasks in ((30, 14), (1000, int(spark.conf.get("spark.sql.shuffle.partitions")))):
        monkeypatch.setattr(star, "LINES_PER_TASK", most)
        quotes = star.fare_quotes(spark, str(tmp_path))
        plan = quotes._jdf.queryExecution().executedPlan().toString()
        assert {int(n) for n in re.findall(dealt, plan)} == {tasks} and quotes.count() == 400
