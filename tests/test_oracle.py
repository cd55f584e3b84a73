"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import difference, duck
from conftest import SF

import __spark_entry__ as entry
from tidewarden.plans.queries import QUERIES
from tidewarden.plans.streams import STREAMS


def test_every_query_has_an_oracle():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {*QUERIES, *STREAMS} <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted({*QUERIES, *STREAMS}))
def test_query(spark, con, name):
    assert difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None
