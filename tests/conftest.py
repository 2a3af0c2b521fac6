import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fareloom.session import build_session, drop_work  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("fareloom-tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_work(session)
    session.stop()


def make_quotes(spark, rows):
    """Quotes from partial dicts; the rest gets plain values."""
    from pyspark.sql import functions as F

    from fareloom.operators.normalize import with_derived
    from fareloom.schema import QUOTES

    plain = {
        "origin": "DEL", "destination": "BOM", "carrier_code": "6E", "carrier_name": "IndiGo",
        "flight_num": "6E 1", "travel_date": "2026-09-10", "advance_purchase_days": 7,
        "fare_class": "economy", "total_fare": 5000.0, "fare_split_estimated": False,
        "departure_time": "10:00", "status": "ok", "scraped_at": "2026-09-01T10:00:00+05:30",
        "capture_run": "r1", "source": "airline_direct", "source_name": "IndiGo",
        "source_scraper": "indigo", "source_file": "f.csv", "data_source_method": "regex_parser"}
    names = QUOTES.fieldNames()
    data = [tuple({**plain, **row}.get(n) for n in names) for row in rows]
    frame = with_derived(spark.createDataFrame(data, QUOTES))
    if any("quality_flags" in row for row in rows):
        flags = [row.get("quality_flags", []) for row in rows]
        table = spark.createDataFrame([(i, f) for i, f in enumerate(flags)],
                                      "i int, quality_flags array<string>")
        numbered = spark.createDataFrame(
            [(i, *tuple({**plain, **row}.get(n) for n in names)) for i, row in enumerate(rows)],
            "i int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in QUOTES))
        return with_derived(numbered).join(table, "i").drop("i")
    return frame.withColumns({"quality_flags": F.array().cast("array<string>"),
                              "confidence_score": F.lit(1.0)})
