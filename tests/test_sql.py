"""Every registered statistics query against its SQL."""

import os

import pytest

from driftwright.plans import queries

from . import sqlcheck

pytestmark = pytest.mark.skipif(not os.path.isdir(sqlcheck.SF), reason="the test tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    sqlcheck.same(spark, queries.QUERIES[name], queries.SQL[name])
