import pytest
from oracle_compare import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, duck, name):
    ok, message, _, n = compare(duck, spark, SF, name)
    assert ok, message
    assert n > 0 or name in entry.oracle_sql()


def test_entry(spark):
    assert entry.entry(spark).count() == 1
