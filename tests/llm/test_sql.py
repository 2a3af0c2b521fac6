"""The queries of this folder that SQL can express, on the smallest test tables."""

import os

import pytest

from check_oracles import compare, connect
from fareloom.llm import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    assert compare(got, connect(FOLDER).sql(catalog.ORACLES[name]).df()) == ""
