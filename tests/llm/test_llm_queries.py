"""Queries that SQL can express agree with it on the small tables."""

import pytest

from quire.llm import registry
from tests.oracle import agree


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    agree(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])
