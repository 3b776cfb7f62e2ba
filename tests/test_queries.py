"""Every registered query against its SQL twin on the smallest data."""

import os

import pytest

from check_queries import compare

import __spark_entry__ as entry_points

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


def test_names_are_registered_once():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ok, note, _ = compare(spark, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok is not False, note


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry(spark):
    assert entry_points.entry(spark).count() == 7
