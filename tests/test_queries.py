"""Every registered query against its SQL twin on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
from shelfwise.plans.catalog import Catalog, query_names
from tests.compare import differences, duck

FOLDER = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()  # loads the queries
NAMES = query_names()


@pytest.fixture(scope="module")
def catalog(spark):
    return Catalog(spark, FOLDER)


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_twin(name, catalog, con):
    if name not in ORACLE:
        assert catalog[name].count() > 0
        return
    problems, rows, odd_types = differences(catalog[name], con, ORACLE[name])
    assert not problems
    assert not odd_types


def test_most_queries_have_a_twin():
    assert sum(name in ORACLE for name in NAMES) >= len(NAMES) - 8


def test_entry_is_the_reorder_frame(spark):
    df = entry.entry(spark)
    assert {"sku_id", "location_id", "qty_to_order", "recommendation_type"} <= set(df.columns)
