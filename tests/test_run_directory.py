"""Appends to the master against the plain anti join, and which of its files they read."""

import os

from pyspark.sql import functions as F

from conftest import make_quotes
from fareloom.operators.dedup import append_new, with_run_part
from fareloom.operators.order_stats import median_and_deviation
from fareloom.plans.daily_run import append_to_master
from fareloom.sources import captures, runs, tables


def batch(spark, numbers, run="r{}", **more):
    return make_quotes(spark, [{"capture_run": run and run.format(i), "flight_num": f"6E {i % 7}",
                                "scraped_at": f"2026-09-{1 + i % 3:02d}T10:00:00+05:30", **more} for i in numbers])


def rows(frame):
    return sorted(map(str, frame.select("capture_run", "flight_num", "scraped_date").collect()))


def test_a_batch_reads_the_folders_of_its_runs_only(spark, tmp_path):
    master = str(tmp_path / "quotes")
    first = batch(spark, range(1000))
    assert append_to_master(first, master).count() == 1000
    new = batch(spark, range(1000, 2000))  # 1 000 runs, in nearly all parts
    assert runs.rows_of_runs(with_run_part(new), master) is None
    assert append_to_master(new, master).count() == 1000
    # three known runs, one of them with a new flight, among 1 000 new ones
    mixed = batch(spark, [5, 900, 901, *range(2000, 3000)]).unionByName(batch(spark, [5], flight_num="AI 1"))
    met = runs.rows_of_runs(with_run_part(mixed), master)
    folders = {tuple(os.path.dirname(path).split("/")[-2:]) for path in met.inputFiles()}
    parts = with_run_part(batch(spark, [5, 900, 901])).select("run_part", "scraped_date").collect()
    assert folders == {(f"run_part={p}", f"scraped_date={d}") for p, d in parts}
    want = append_new(tables.read_table(spark, master), mixed)
    want = rows(want)
    assert len(want) == 1001 and rows(append_to_master(mixed, master)) == want
    assert append_to_master(mixed, master).count() == 0
    assert tables.read_table(spark, master).count() == 3001
    known = runs.directory(spark, master)
    assert known.count() == known.distinct().count() == 3000


def test_runs_without_a_name_older_tables_and_lost_jobs(spark, tmp_path):
    master = str(tmp_path / "quotes")
    nameless = batch(spark, range(3), run=None)
    with_run_part(nameless).write.partitionBy("run_part", "scraped_date").parquet(master)  # no directory yet
    assert append_to_master(nameless, master).count() == 0
    assert append_to_master(batch(spark, range(3), run=""), master).count() == 3  # an empty name is not a missing one
    # a directory row whose quotes were never written
    spark.createDataFrame([(1, "lost", "2026-09-09")], "run_part int, run string, scraped_date string").write.mode(
        "append").parquet(f"{master}_runs")
    lost = with_run_part(batch(spark, [1], run="lost")).withColumn("run_part", F.lit(1))
    assert runs.rows_of_runs(lost, master) is None
    assert append_to_master(nameless.limit(0), master).count() == 0
    assert append_to_master(nameless.limit(0), str(tmp_path / "none")).count() == 0


def test_empty_files_are_rejects_in_an_incremental_scan_too(spark, tmp_path):
    for name, at in (("old", 946_684_800), ("new", 1_893_456_000)):
        path = tmp_path / "d" / f"indigo_{name}.csv"
        path.parent.mkdir(exist_ok=True)
        path.write_text("")
        os.utime(path, (at, at))

    def names(**more):
        return sorted(r["source_file"].rsplit("_", 1)[1] for r in captures.file_rejects(spark, str(tmp_path), **more).collect())

    assert names() == ["new.csv", "old.csv"]
    assert names(modified_after="2026-01-01T00:00:00") == ["new.csv"]


def test_median_and_deviation_scan_once_and_write_nothing(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.range(5000).selectExpr("id % 3 AS k", "1000 + id % 97 AS v").write.parquet(path)
    result = median_and_deviation(spark.read.parquet(path), ["k"], "v")
    assert sorted((r["k"], r["median"], r["mad"]) for r in result.collect()) == [(k, 1048.0, 24.0) for k in range(3)]
    plan = result._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 1 and "ReusedExchange" in plan
