"""Every registered query on the smallest tables, against its SQL where it has one."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as driver  # noqa: E402
from oracle_check import check  # noqa: E402

from breathline import catalog  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = driver.queries(), driver.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")


@pytest.mark.parametrize("name", sorted(catalog.all_queries()))
def test_query(spark, name):
    problem, rows, _ = check(spark, SF, name, QUERIES[name], SQL.get(name))
    assert not problem, problem
    assert rows > 0


def test_registry():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
