"""Every registered plan against its SQL text on the smallest tables, and a look at its physical plan."""

import pytest

import compare
from fieldtide.plans.catalog import PLANS, SQL

SF = "/root/testdata/sf0.001"
# Joins without an equality, and windows over everything, do not scale. limit_tiles numbers the rows of its own limit.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")
GLOBAL_WINDOW = {"limit_tiles"}


def test_every_sql_text_has_a_plan():
    assert set(SQL) <= set(PLANS)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_plan(spark, name):
    df = PLANS[name](spark, SF)
    text = df._jdf.queryExecution().executedPlan().toString()
    for bad in FORBIDDEN:
        assert bad not in text, f"{bad} in {name}"
    if name not in GLOBAL_WINDOW:
        assert "Exchange SinglePartition, ENSURE_REQUIREMENTS" not in text or "Window" not in text
    rows = compare.ordered(df.columns, [tuple(r) for r in df.collect()])
    if name in SQL:
        assert rows == compare.oracle(SF, SQL[name])
    else:
        assert rows[1]
