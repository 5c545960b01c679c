"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from echoloom import catalog
from tools.compare import compare, duck

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    good, text = compare(spark, con, name, SF, entry.queries(), entry.oracle_sql())
    assert good, text


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row.questions > 0 and 0 <= row.f1 <= 100


def test_each_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
