import pytest

import __spark_entry__
from docfacts.plans import catalogue
from oracle import assert_equal, database


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, sf, con, name):
    assert_equal(catalogue.queries()[name](spark, sf), con, catalogue.oracle_sql()[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
