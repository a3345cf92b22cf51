"""Every registered query runs, is not empty, and equals its SQL form where it has one."""

import pytest

from brindle.plans import oracles, queries, registry

from .compare import connect, duck_rows, spark_rows

DATA = "/root/testdata/sf0.001"
ORACLES = oracles.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, db, name):
    names, rows = spark_rows(queries.queries()[name](spark, DATA))
    assert rows
    if name in ORACLES:
        assert (names, rows) == duck_rows(db, ORACLES[name])


@pytest.mark.parametrize("name", sorted(registry.CASES))
def test_case(spark, db, name):
    function, sql = registry.CASES[name]
    assert spark_rows(function(spark, DATA)) == duck_rows(db, sql)


def test_entry_names():
    import __spark_entry__ as entry

    assert set(queries.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
