"""Every registered query of the document engine agrees with its SQL."""

import pytest

from quire.plans import registry
from tests.oracle import agree


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    agree(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_bad_json_lines_are_not_glued(spark):
    """No text holds all lines of a user, whose number has no bound."""
    from quire.plans import more
    from tests.oracle import SMALL

    plan = more.r8b_bad_json_lines(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "user_id" in plan
