"""Table layouts."""

from pyspark.sql import types as T

_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# Capture files carry text only; older files stop after ``capture_run``.
RAW_COLUMNS = [
    "origin", "destination", "carrier_code", "carrier_name", "flight_num", "travel_date",
    "advance_purchase_days", "fare_class", "base_fare", "taxes_and_fees", "total_fare",
    "fare_split_estimated", "departure_time", "status", "scraped_at", "capture_run",
    "source", "source_name",
]
RAW_QUOTES = _struct(*[(name, _S) for name in RAW_COLUMNS])

QUOTES = _struct(
    ("origin", _S), ("destination", _S), ("carrier_code", _S), ("carrier_name", _S),
    ("flight_num", _S), ("travel_date", _S), ("advance_purchase_days", _I),
    ("fare_class", _S), ("base_fare", _D), ("taxes_and_fees", _D), ("total_fare", _D),
    ("fare_split_estimated", _B), ("departure_time", _S), ("status", _S),
    ("scraped_at", _S), ("capture_run", _S), ("source", _S), ("source_name", _S),
    ("source_scraper", _S), ("source_file", _S), ("data_source_method", _S),
    ("raw_html_sample_path", _S),
)
REQUIRED_TEXT = ["origin", "destination", "carrier_code", "carrier_name", "flight_num",
                 "travel_date", "departure_time", "scraped_at", "capture_run"]

FORECAST = _struct(
    ("ds", _S), ("target", _S), ("yhat", _D), ("yhat_lower", _D), ("yhat_upper", _D),
    ("forecast_confidence", _D), ("is_forecast", _B),
)

_SELECTOR = _struct(("value", _S), ("last_verified_at", _S), ("verified_by", _S))
REGISTRY = _struct(
    ("site", _S),
    ("selectors", T.MapType(_S, _SELECTOR)),
    ("pending_review", T.MapType(_S, T.StringType())),
)
HEALING_LOG = _struct(
    ("timestamp", _S), ("site", _S), ("target_field", _S),
    ("known_good_examples", T.ArrayType(_S)), ("success", _B), ("selector", _S),
    ("confidence", _D), ("validation_reason", _S), ("match_count", _I), ("error", _S),
    ("reasoning", _S),
)
METRICS = _struct(
    ("run_id", _S), ("stage", _S), ("duration_seconds", _D), ("rows", T.LongType()),
    ("metrics", T.MapType(_S, _S)),
)
