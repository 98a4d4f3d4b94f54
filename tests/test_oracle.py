"""Every query equals its SQL on the small test tables."""

import pytest

import __spark_entry__ as driver
from tiffin import catalog, oracles
from comparison import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query_equals_sql(spark, name):
    assert differences(catalog.QUERIES[name](spark, SF), SF, driver.oracle_sql()[name]) is None


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracles.oracle_sql())
    assert set(driver.queries()) >= set(catalog.QUERIES)
