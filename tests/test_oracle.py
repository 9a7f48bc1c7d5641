"""Every registered query against its SQL on the smallest tables."""

import oracle
import pytest

from urbanpulse import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, name):
    assert oracle.compare(spark, name, FOLDER) is None


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() == 6
