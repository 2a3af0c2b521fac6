"""The incremental index against the full one, and what a second batch reads and writes."""

import os
import re

from pyspark.sql import functions as F

from conftest import make_quotes
from fareloom import constants as C
from fareloom.operators.outliers import flag_mad
from fareloom.plans import incremental as I
from fareloom.plans.fare_index import fare_index_daily
from fareloom.sources.tables import partition_values

ROUTES = [r.split("-") for r in C.BASKET]


def day(date, fares, **more):
    """Quotes of one date: every fare on every basket route."""
    return [{"origin": o, "destination": d, "total_fare": float(f + 10 * k), "scraped_at": f"{date}T10:00:00+05:30",
             "advance_purchase_days": 7, "flight_num": f"6E {k}{i}", **more}
            for k, (o, d) in enumerate(ROUTES) for i, f in enumerate(fares)]


def files(store, table):
    return {os.path.relpath(os.path.join(root, name), store) for root, _, names in os.walk(os.path.join(store, table))
            for name in names if name.endswith(".parquet")}


def full(quotes):
    return sorted(map(tuple, fare_index_daily(flag_mad(quotes)).collect()), key=lambda r: r[0])


def kept(spark, store):
    index = I.current_index(spark, store)
    names = ["date", "composite_fare_index", "composite_daily_fare", "data_completeness",
             *[f"{kind}_{r}" for r in C.BASKET for kind in ("index", "fare")]]
    return sorted(map(tuple, index.select(*[F.col(f"`{n}`") for n in names]).collect()), key=lambda r: r[0])


def test_a_new_day_reads_and_writes_its_own_folders(spark, tmp_path):
    store = str(tmp_path)
    first = day("2026-09-01", [5000, 5100, 5200]) + day("2026-09-02", [5050, 5150, 5300])
    second = day("2026-09-03", [5100, 5150, 5200])
    assert I.update_index(make_quotes(spark, first), store, "b1") == ["2026-09-01", "2026-09-02"]
    before = {t: files(store, t) for t in ("fare_counts", "index_days", "index")}
    assert I.update_index(make_quotes(spark, second), store, "b2") == ["2026-09-03"]
    for table, held in before.items():
        now = files(store, table)
        assert held <= now and now - held and all("2026-09-03" in f for f in now - held), table
    rows = I.day_rows(spark, store, ["2026-09-03"], "b2", C.WEIGHTS_V1, C.BASKET)
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    scans = [part for part in plan.split("\n\n") if "Scan parquet" in part and "fare_counts" in part]
    assert scans and all(re.search(r"PartitionFilters: .*2026-09-03", part) for part in scans), scans
    assert kept(spark, store) == full(make_quotes(spark, first + second))
    # the newest batch once more: the same state
    I.update_index(make_quotes(spark, second), store, "b2")
    assert kept(spark, store) == full(make_quotes(spark, first + second))


def test_limits_that_move_touch_earlier_days(spark, tmp_path):
    store = str(tmp_path)
    first = day("2026-09-01", [5000, 5010, 5020, 5030]) + day("2026-09-02", [5005, 5015, 7000])
    second = day("2026-09-03", [6000, 7000, 8000, 9000, 6500, 7500, 5500, 6900])
    I.update_index(make_quotes(spark, first), store, "b1")
    touched = I.update_index(make_quotes(spark, second), store, "b2")
    assert touched == ["2026-09-02", "2026-09-03"]  # 7000 was far on the second day
    assert kept(spark, store) == full(make_quotes(spark, first + second))


def test_late_quotes_and_a_new_first_day(spark, tmp_path):
    store = str(tmp_path)
    parts = [day("2026-09-02", [5000, 5100, 5200]), day("2026-09-01", [4000, 4050, 4100]) + day("2026-09-02", [5150, 5175]),
             day("2026-09-02", [5500], status="sold_out") + day("2026-09-04", [5000, 0])]
    for k, part in enumerate(parts):
        I.update_index(make_quotes(spark, part), store, f"b{k}")
    assert kept(spark, store) == full(make_quotes(spark, sum(parts, [])))
    # all fares of the first of September are far by now, so that day, the base until then, is gone
    assert partition_values(spark, f"{store}/index", "date") == ["2026-09-02", "2026-09-04"]
    assert I.update_index(make_quotes(spark, day("2026-09-05", [1], status="sold_out")), store, "b9") == []
    try:
        I.update_index(make_quotes(spark, parts[0]), store, "b0")
    except ValueError as error:
        assert "b2" in str(error)
    else:
        raise AssertionError("an older batch was applied")


def _captures(folder, rows):
    from fareloom.schema import RAW_COLUMNS
    from test_ingest_and_pages import PLAIN
    lines = [",".join(RAW_COLUMNS)] + [",".join({**PLAIN, **row}[c] for c in RAW_COLUMNS) for row in rows]
    folder.mkdir(parents=True)
    (folder / "indigo_raw.csv").write_text("\n".join(lines) + "\n")


def test_increments_of_captures_equal_a_full_run(spark, tmp_path):
    from fareloom.plans.daily_run import run_daily, run_increment
    from fareloom.sources.metrics import read_metrics
    raw, store = tmp_path / "raw", str(tmp_path / "store")

    def row(d, flight, fare, hour=2):
        return {"flight_num": flight, "total_fare": fare, "scraped_at": f"2026-09-0{d}T0{hour}:00:00+05:30", "capture_run": f"r{d}"}

    _captures(raw / "1", [row(1, f"6E {k}", str(5000 + k), 9) for k in range(6)] + [row(2, "6E 9", "7000", 9)])
    run_increment(spark, str(raw), store, batch="b1")
    before = files(store, "flagged") | files(store, "state/index")
    _captures(raw / "2", [row(3, f"6E {k}", str(5100 + k), 9) for k in range(4)] + [row(3, "6E 7", "", 9)])
    out = run_increment(spark, str(raw), store, batch="b2")
    new = (files(store, "flagged") | files(store, "state/index")) - before
    assert before <= files(store, "flagged") | files(store, "state/index") and new and all("2026-09-03" in f for f in new)
    whole = run_daily(spark, str(raw), str(tmp_path / "whole"), skip_forecast=True, run_id="w")
    names = ["date", "composite_fare_index", "composite_daily_fare", "data_completeness"]
    assert sorted(out["index"].select(names).collect()) == sorted(whole["index"].select(names).collect())
    key = ["flight_num", "scraped_at", "confidence_score"]
    assert sorted(map(tuple, out["flagged"].select(*key, F.concat_ws(",", "quality_flags")).collect())) == sorted(
        map(tuple, whole["flagged"].select(*key, F.concat_ws(",", "quality_flags")).collect()))
    rows = {r["stage"]: r for r in read_metrics(spark, f"{store}/metrics").where("run_id = 'b2'").collect()}
    assert rows["quotes"]["rows"] == 5 and rows["flagged"]["rows"] == 5 and rows["excluded"]["rows"] == 1
    again = run_increment(spark, str(raw), store, batch="b3")  # nothing new
    assert again["quotes"].count() == 12
