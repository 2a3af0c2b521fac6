"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder with the tables, BENCH_CPUS the number of local threads.
Shared inputs (quotes, flagged quotes) are stage tables, timed under ``stage_*``; session
start and a small warm-up query are not counted.
"""

from __future__ import annotations

import json
import os
import time

from fareloom.catalog import queries as catalog
from fareloom.session import build_session, drop_work

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
STAGES = {"stage_quotes": catalog._quotes, "stage_quality": catalog._scored,
          "stage_mad": catalog._mad, "stage_iqr": catalog._iqr}
HEADLINE = ["fare_index_daily", "daily_composite", "forest_flags", "event_forecast",
            "confirmed_keys", "latest_quotes", "excluded_fare_audit", "appended_quotes",
            "route_trajectory", "route_heatmap", "route_contribution", "provenance_stats",
            "coverage_gaps", "fare_sample", "valid_quotes", "direct_cards", "failure_runs",
            "clean_pages"]


def main() -> None:
    spark = build_session("fareloom-bench", f"local[{CPUS}]", CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times, rows = {}, 0
    for name, build in STAGES.items():
        began = time.monotonic()
        table = build(spark, FOLDER)  # written as Parquet
        times[name] = round(time.monotonic() - began, 3)
        rows = rows or table.count()
    for name in HEADLINE:
        began = time.monotonic()
        catalog.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.monotonic() - began, 3)
    total = round(sum(times.values()), 3)
    core = sum(times[n] for n in ("stage_quality", "stage_mad", "fare_index_daily", "forest_flags"))
    print(json.dumps({"metric": "airfare index queries, total wall time", "value": total,
                      "unit": "sec", "queries": times, "sf": FOLDER.rstrip("/").split("/sf")[-1],
                      "quotes": rows, "core_rows_per_sec": round(rows / core)}))
    drop_work(spark)
    spark.stop()


if __name__ == "__main__":
    main()
