"""Every registered query against its SQL twin, over whole tables."""

import pytest
from compare import DATA, compare, database

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", list(queries()))
def test_query_matches_oracle(spark, con, name):
    difference, _ = compare(spark, con, FOLDER, queries()[name], oracle_sql().get(name))
    assert difference == ""


def test_entry_returns_rows(spark):
    assert entry(spark).count() > 0
