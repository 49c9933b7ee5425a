"""Every registered query against its SQL; those without SQL have tests of their own and must give rows here."""

import pytest

import __spark_entry__ as entry
import harness
from trajspark.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.SQL)
REST = sorted(set(registry.QUERIES) - set(NAMES))


@pytest.fixture(scope="module")
def duck():
    return harness.duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    assert harness.compare(entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", REST)
def test_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
