"""Every registered core query beside its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from graphloom.plans.registry import gather  # noqa: E402
from oracle import connect, difference  # noqa: E402

QUERIES, SQL = gather()
#: Iterative results that SQL cannot state in reasonable time; they are tested against brute force elsewhere.
WITHOUT_SQL = {"communities", "traced_model_calls"}


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


def test_every_query_has_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL and not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, small_dir, con, name):
    assert difference(QUERIES[name](spark, small_dir), con, SQL[name]) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["affected_id", "via_id", "connection_id", "impact_type"]
    assert set(QUERIES) <= set(__spark_entry__.queries())
