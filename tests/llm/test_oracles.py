"""Registered queries against their SQL, and the names that are registered."""

import pytest

from cedarflow.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
