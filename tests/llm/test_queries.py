"""The subpackage's queries on the smallest tables, beside SQL where there is any."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from graphloom.llm.queries import QUERIES, SQL  # noqa: E402
from oracle import connect, difference  # noqa: E402


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    if name in SQL:
        assert difference(df, connect(small_dir), SQL[name]) == ""
    else:
        assert df.count() > 0
