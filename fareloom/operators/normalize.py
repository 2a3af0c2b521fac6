"""From capture text to validated quotes, with rejects on the side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import QUOTES, RAW_COLUMNS, REQUIRED_TEXT

_AMOUNTS = ["total_fare", "base_fare", "taxes_and_fees"]


def _reasons():
    """Rule texts in the order in which they are checked; null where a rule holds."""
    bad = [F.when(S.number_is_bad(F.col(f"raw_{name}")), F.lit(f"{name}: not a number"))
           for name in _AMOUNTS]
    bad.append(F.when(F.col("fare_split_estimated").isNull(),
                      F.lit("fare_split_estimated: not a boolean")))
    bad.append(F.when(F.col("advance_purchase_days").isNull(),
                      F.lit("advance_purchase_days: not a whole number")))
    bad.append(F.when(F.col("status").isNull(), F.lit("status: unrecognized")))
    bad += [F.when(F.col(name).isNull(), F.lit(f"{name}: required")) for name in REQUIRED_TEXT]
    bad.append(F.when(~F.col("source").isin("airline_direct", "ota"),
                      F.lit("source: not allowed")))
    return F.array_compact(F.array(*bad))


def normalize(raw: DataFrame) -> DataFrame:
    """All rows in canonical form with ``errors`` (empty when valid) and the raw row as JSON.

    ``raw`` has the capture columns as text plus ``source_scraper`` and ``source_file``.
    Extra columns are ignored.
    """
    extra = {name: F.col(name) if name in raw.columns else F.lit(None).cast("string")
             for name in ("data_source_method", "raw_html_sample_path")}
    text = {name: F.trim(F.col(name)) for name in REQUIRED_TEXT}
    kept = raw.select(
        *RAW_COLUMNS, "source_scraper", "source_file",
        *[column.alias(name) for name, column in extra.items()],
        *[F.col(name).alias(f"raw_{name}") for name in _AMOUNTS],
        F.to_json(F.struct(*RAW_COLUMNS)).alias("raw_row"))
    typed = kept.withColumns({
        **text,
        **{name: S.parse_number(F.col(name)) for name in _AMOUNTS},
        "fare_split_estimated": S.parse_flag(F.col("fare_split_estimated")),
        "fare_class": F.coalesce(S.fare_class_name(F.col("fare_class")), F.lit("unknown")),
        "advance_purchase_days": S.parse_horizon(F.col("advance_purchase_days")),
        "status": S.canonical_status(F.col("status")),
        "source": S.source_kind(F.col("source"), F.col("source_scraper")),
        "source_name": S.source_label(F.col("source_name"), F.col("source_scraper")),
        "data_source_method": F.coalesce("data_source_method", F.lit("regex_parser")),
    })
    return typed.select(*QUOTES.fieldNames(), "raw_row", _reasons().alias("errors"))


def valid_quotes(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.size("errors") == 0).select(*QUOTES.fieldNames())


def rejected_rows(normalized: DataFrame) -> DataFrame:
    """``source_file, error, raw_row`` of the rows that broke a rule."""
    return normalized.where(F.size("errors") > 0).select(
        "source_file", F.concat_ws("; ", "errors").alias("error"), "raw_row")


def rejection_reasons(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("error").agg(F.count(F.lit(1)).alias("n_rows"))


def with_derived(quotes: DataFrame) -> DataFrame:
    """Add ``route``, the capture instant and its UTC date."""
    stamp = F.col("scraped_at")
    return quotes.withColumns({
        "route": S.route_name(F.col("origin"), F.col("destination")),
        "scraped_ts": S.capture_instant(stamp), "scraped_date": S.utc_date(stamp)})


def for_export(df: DataFrame, blank_text: bool = False) -> DataFrame:
    """NaN to null; with ``blank_text`` missing text becomes ''."""
    numbers = {n: S.without_nan(F.col(n)) for n, kind in df.dtypes if kind in ("double", "float")}
    words = {n: F.coalesce(n, F.lit("")) for n, kind in df.dtypes
             if blank_text and kind == "string"}
    return df.withColumns({**numbers, **words})
