"""Every registered query runs on the smallest tables, and agrees with its SQL where it has one."""

import os

import pytest

import __spark_entry__ as entry
from workload.check import compare

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "pos", "role", "part_pos", "part_type", "text"] and df.count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert query(spark, SF).count() > 0
    else:
        assert compare(spark, SF, name, query, sql).startswith("ok"), name
