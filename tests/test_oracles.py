"""Every operator family against SQL on the smallest test tables."""

import os

import pytest

from check_oracles import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = ["fare_index_daily", "quality_scores", "mad_flags", "iqr_bounds", "daily_composite",
         "confirmed_keys", "latest_quotes", "appended_quotes", "coverage_gaps", "route_heatmap",
         "route_trajectory", "event_forecast", "failure_runs", "rejected_quotes", "direct_cards",
         "line_offers", "clean_pages"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    from __spark_entry__ import oracle_sql, queries
    result = queries()[name](spark, FOLDER).toPandas()
    assert compare(result, connect(FOLDER).sql(oracle_sql()[name]).df()) == ""


def test_every_oracle_has_a_query():
    from __spark_entry__ import oracle_sql, queries
    assert set(oracle_sql()) <= set(queries())
