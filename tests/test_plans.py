"""Every registered query against its oracle, on the smallest tables."""

import os

import harness
import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("FINFRAME_SF_DIR", "/root/testdata/sf0.001")
BUILDERS, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return harness.oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(BUILDERS))
def test_query(spark, con, name):
    got = harness.spark_rows(BUILDERS[name](spark, SF_DIR))
    if name in ORACLES:
        assert harness.difference(got, harness.oracle_rows(con, ORACLES[name])) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(BUILDERS)


def test_entry(spark):
    assert entry.entry(spark).count() == 5
