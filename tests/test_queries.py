"""Every query of the listings engine against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from curbside.plans.oracle import ORACLE
from curbside.plans.queries import REGISTRY
from harness import compare, duck

FOLDER = "/root/testdata/sf0.001"
# Of the smallest tables no row gets into these results.
MAY_BE_EMPTY = {"filter_price", "extract_search_rows_simple"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, name):
    problem = compare(spark, con, name, REGISTRY[name], ORACLE.get(name), FOLDER)
    assert problem is None or name in MAY_BE_EMPTY and problem.endswith("both empty"), problem


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLE)
    assert set(entry.queries()) >= set(REGISTRY)
    assert set(entry.oracle_sql()) >= set(ORACLE)


def test_entry(spark):
    assert entry.entry(spark).count() == 2
