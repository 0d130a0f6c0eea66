"""Every registered query against its oracle statement on the smallest tables."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry_module.queries()))
def test_query(spark, con, name):
    diff, _, _ = difference(name, spark, con, SF)
    assert diff is None, diff


def test_entry(spark):
    assert entry_module.entry(spark).columns[:2] == ["id", "timestamp_us"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
