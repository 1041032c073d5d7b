"""Each training-data query with a SQL twin gives the twin's rows."""

import os

import pytest
from compare import differences, duck

from dwellframe.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_equals_sql(spark, name):
    build, sql = QUERIES[name]
    assert differences(build(spark, SF_DIR), duck(SF_DIR), sql) == []
