"""Every registered query against its SQL twin, over whole tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

SMALL = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="session")
def database():
    return connect(SMALL)


def test_every_twin_belongs_to_a_query():
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, database, name):
    run = entry.queries()[name]
    if name in ORACLE:
        assert difference(spark, database, SMALL, run, ORACLE[name]) is None
    else:
        assert run(spark, SMALL).columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
