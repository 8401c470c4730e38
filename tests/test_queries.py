"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import pytest
from conftest import DATA
from oracle import differences

from sitelode.plans import PLANS

# What the smallest tables have none of.
MAY_BE_EMPTY: set[str] = set()


@pytest.mark.parametrize("name", [n for n, p in PLANS.items() if p.sql])
def test_agrees_with_sql(spark, oracle, name):
    found = differences(PLANS[name].run(spark, DATA), oracle, PLANS[name].sql)
    assert found == (["no rows"] if name in MAY_BE_EMPTY else [])


@pytest.mark.parametrize("name", [n for n, p in PLANS.items() if not p.sql])
def test_gives_rows(spark, name):
    assert PLANS[name].run(spark, DATA).count() > 0


@pytest.mark.parametrize("name", [n for n in PLANS if not n.startswith("stream_")])
def test_plan_has_no_cross_join_and_no_global_window(spark, name):
    plan = PLANS[name].run(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    if "Window [" in plan:
        assert "Exchange SinglePartition" not in plan


def test_entry_point():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(PLANS) <= set(entry.queries())


@pytest.mark.parametrize(
    ("name", "scans"),
    [("gated_events", 1), ("event_totals", 1), ("series_navigation", 2), ("series_cards", 2), ("reference_counts", 2), ("related_items", 2), ("image_dimensions", 4)],
)
def test_a_plan_reads_its_table_no_more_often(spark, name, scans):
    plan = PLANS[name].run(spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") <= scans
    assert "ResolvedHint" not in plan and "Window" not in plan or name.startswith("series")
