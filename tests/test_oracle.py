"""Every registered query that has SQL equals it."""

import pytest

from candleforge.plans import queries as Q
from oracle import assert_same, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_equals_sql(spark, con, name):
    assert_same(Q.queries()[name](spark, SF), con, Q.oracle_sql()[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
