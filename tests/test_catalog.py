"""Every registered query against its SQL on the smallest tables; ``compare.py`` takes any."""

import pytest
from compare import difference, open_tables

import __spark_entry__ as contract
from lodestone.catalog import load

FOLDER = "/root/testdata/sf0.001"
# Queries of subpackages that may be taken out have tests of their own.
NAMES = tuple(load().queries)


def test_every_query_has_a_check():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 60


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_check(spark, name):
    found = contract.queries()[name](spark, FOLDER).toPandas()
    expected = open_tables(FOLDER).execute(contract.oracle_sql()[name]).df()
    assert difference(found, expected) is None


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1
