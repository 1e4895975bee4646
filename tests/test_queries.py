"""Registered queries against their SQL twins on the smallest sample."""

import os

import oracle
import pytest

from tallyweave.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables absent")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal(spark, con, name):
    ok, note = oracle.compare(spark, con, SF, QUERIES[name], ORACLES[name])
    assert ok, note


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
