"""Queries against their SQL forms."""

import pytest

from brindle.llm import oracles, queries

from ..compare import connect, duck_rows, spark_rows
from .fixtures import DATA


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, DATA)) == duck_rows(connect(DATA), oracles.oracle_sql()[name])
