"""The whole daily run: captures -> quotes -> scores -> outliers -> index -> forecast.

Every stage is a table, so a later stage, another job or a rerun starts from files and not
from a long lineage.  Each stage's counts go to the metrics table.
"""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import append_new, with_run_part
from ..operators.forecast import forecast_index
from ..operators.forest import flag_forest
from ..operators.normalize import normalize, rejected_rows, valid_quotes, with_derived
from ..operators.outliers import flag_mad
from ..operators.quality import oldest_verified, quality_scores, stale_sources
from ..session import materialise, prepare
from ..sources.captures import file_rejects, read_raw_quotes, without_rejected_files
from ..sources.metrics import index_metrics, row_metrics, save_metrics, scored_metrics, write_observed
from ..sources.registry import read_registries, registry_selectors
from ..sources.runs import append_rows, rows_of_runs
from ..sources.tables import read_table, replace_partitions, table_exists, write_stage
from .fare_index import excluded_fares, fare_index_daily
from .incremental import current_index, limits_at, update_index

STAGES = ["quotes", "rejects", "scored", "flagged", "anomalies", "index", "excluded", "forecast",
          "metrics"]


def append_to_master(fresh: DataFrame, master: str) -> DataFrame:
    """Append, and return, the quotes whose key ``master`` lacks, in folders by hash of the run and capture date.

    Only folders that hold a run of the batch are read, so a batch of new runs reads no quote.
    """
    # written out first: joining on top of the long normalising plan is slow to optimise
    fresh = materialise(with_run_part(fresh), "fresh-quotes")
    if fresh.isEmpty():
        return fresh
    seen = rows_of_runs(fresh, master)
    if seen is not None:
        fresh = materialise(append_new(seen, fresh), "new-quotes")
    append_rows(fresh, master)
    return fresh


def ingest(spark: SparkSession, raw_root: str, store: str, modified_after: str | None = None) -> DataFrame:
    """Append new quotes to the master table, write the rejects of rows and whole files, return the master."""
    take_in(spark, raw_root, store, modified_after)
    return read_table(spark, f"{store}/quotes")


def take_in(spark: SparkSession, raw_root: str, store: str, modified_after: str | None = None) -> DataFrame:
    """As :func:`ingest`, but the new quotes are returned."""
    broken = materialise(file_rejects(spark, raw_root, modified_after), "file-rejects")
    raw = without_rejected_files(read_raw_quotes(spark, raw_root, modified_after=modified_after), broken)
    checked = materialise(normalize(raw), "normalised")
    fresh = append_to_master(with_derived(valid_quotes(checked)), f"{store}/quotes")
    write_stage(rejected_rows(checked).unionByName(broken), f"{store}/rejects")
    return fresh


def _stages(spark: SparkSession, store: str, run_id: str):
    """A function that writes one stage, measured while it is written, and gives its table."""

    def stage(name: str, build, measures=row_metrics, written: bool = False, days: list[str] | None = None) -> DataFrame:
        began = time.monotonic()

        def write(rows: DataFrame) -> None:
            if days is not None:
                replace_partitions(rows, f"{store}/{name}", ["scraped_date"], empty=None)
            else:
                write_stage(rows, f"{store}/{name}", "scraped_date" if "scraped_date" in rows.columns else None)

        try:
            built = build()
            values = {"rows": built.count()} if written else write_observed(built, measures, write)
        except Exception as error:
            save_metrics(spark, run_id, name, time.monotonic() - began,
                         {"status": "failed", "error": type(error).__name__}, f"{store}/metrics")
            raise
        save_metrics(spark, run_id, name, time.monotonic() - began, values, f"{store}/metrics")
        return built if written else read_table(spark, f"{store}/{name}")

    return stage


def run_increment(spark: SparkSession, raw_root: str, store: str, registry_root: str | None = None,
                  now: str | None = None, batch: str | None = None, weights: dict[str, float] | None = None,
                  basket: list[str] | None = None, modified_after: str | None = None) -> dict[str, DataFrame]:
    """Take in what is new and redo the days that it touches; the index is that of a full run.

    Quotes are read from the folders of touched days only, which are replaced in ``scored``, ``flagged`` and
    ``excluded``; index and statistical limits come from the counts that :mod:`.incremental` keeps.  The
    isolation forest looks at whole routes and belongs to :func:`run_daily`.
    """
    prepare(spark)
    clock = datetime.now(timezone.utc)
    now, batch = now or clock.isoformat(), batch or clock.strftime("%Y%m%dT%H%M%SZ")
    stage, state = _stages(spark, store, batch), f"{store}/state"
    fresh = stage("quotes", lambda: take_in(spark, raw_root, store, modified_after), written=True)
    began = time.monotonic()
    days = update_index(fresh, state, batch, weights, basket)
    # days without a priced ok quote have no part in the index, but their rows are scored as well
    new_days = [row[0] for row in fresh.select("scraped_date").where("scraped_date is not null").distinct().collect()]
    days = sorted({*days, *new_days})
    save_metrics(spark, batch, "index", time.monotonic() - began, {"rows": len(days), "days": ",".join(days)}, f"{store}/metrics")
    if days:
        quotes = read_table(spark, f"{store}/quotes").where(F.col("scraped_date").isin(days))
        stale = None
        if registry_root:
            stale = stale_sources(oldest_verified(registry_selectors(read_registries(spark, registry_root))), now)
        scored = stage("scored", lambda: quality_scores(quotes, stale), scored_metrics, days=days)
        touched = scored.where(F.col("scraped_date").isin(days))
        limits = limits_at(spark, state, batch)
        flagged = stage("flagged", lambda: flag_mad(touched, limits=limits), scored_metrics, days=days)
        stage("excluded", lambda: excluded_fares(flagged.where(F.col("scraped_date").isin(days))), days=days)
    tables = {name: read_table(spark, f"{store}/{name}") for name in ("quotes", "rejects", "scored", "flagged", "excluded")
              if table_exists(spark, f"{store}/{name}")}
    return tables | ({"index": current_index(spark, state)} if table_exists(spark, f"{state}/index") else {})


def run_daily(spark: SparkSession, raw_root: str, store: str, registry_root: str | None = None,
              now: str | None = None, skip_forecast: bool = False, run_id: str | None = None,
              weights: dict[str, float] | None = None, basket: list[str] | None = None,
              forest_options: dict | None = None, modified_after: str | None = None) -> dict[str, DataFrame]:
    """Run all stages below the folder ``store``; returns the stage tables.

    ``now`` (ISO text) decides which selectors are stale; give it to repeat an old run.
    """
    prepare(spark)
    clock = datetime.now(timezone.utc)
    now, run_id = now or clock.isoformat(), run_id or clock.strftime("%Y%m%dT%H%M%SZ")
    stage = _stages(spark, store, run_id)

    def scored() -> DataFrame:
        stale = None
        if registry_root:
            selectors = registry_selectors(read_registries(spark, registry_root))
            stale = stale_sources(oldest_verified(selectors), now)
        return quality_scores(quotes, stale)

    quotes = stage("quotes", lambda: ingest(spark, raw_root, store, modified_after), written=True)
    stage("scored", scored, scored_metrics)
    scores = read_table(spark, f"{store}/scored")

    def flagged_twice() -> DataFrame:
        # the forest looks at its input several times, so the first pass is written out
        return flag_forest(materialise(flag_mad(scores), "mad-flags"), **(forest_options or {}))

    flagged = stage("flagged", flagged_twice, scored_metrics)
    stage("anomalies", lambda: flagged.where(
        F.exists("quality_flags", lambda flag: flag.startswith("price_anomaly"))))
    index = stage("index", lambda: fare_index_daily(flagged, weights, basket), index_metrics)
    stage("excluded", lambda: excluded_fares(flagged))
    if skip_forecast:
        save_metrics(spark, run_id, "forecast", 0.0, {"executed": False}, f"{store}/metrics")
    else:
        stage("forecast", lambda: forecast_index(index))
    return {name: read_table(spark, f"{store}/{name}") for name in STAGES[:-1]
            if table_exists(spark, f"{store}/{name}")}
