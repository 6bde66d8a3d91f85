"""The corpus queries that SQL can express, against it."""

import os

import pytest

from driftwright.llm import queries

from .. import sqlcheck

pytestmark = pytest.mark.skipif(not os.path.isdir(sqlcheck.SF), reason="the test tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    sqlcheck.same(spark, queries.queries()[name], queries.oracle_sql()[name])
