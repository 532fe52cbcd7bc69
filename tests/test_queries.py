"""Every registered query of the toolkit against its SQL."""

import pytest

from cedarflow.plans import catalogue
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    compare(spark, catalogue.QUERIES[name], catalogue.ORACLES[name])


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
