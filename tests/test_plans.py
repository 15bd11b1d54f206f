"""Plan-shape guards: no pair-producing joins, no Python in any plan, pruned and pushed scans."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from tillage.plans.registry import registered

SF = "/root/testdata/sf0.001"
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"]


def plan_of(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(r.name for r in registered()))
def test_no_cross_products_or_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    for op in FORBIDDEN:
        assert op not in plan, f"{name} plans {op}"


def test_flagship_scan_is_pruned(spark):
    plan = plan_of(entry.queries()["r12_top_products"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double,l_extendedprice:double>" in plan


def test_time_filter_reaches_the_scan(spark):
    plan = plan_of(entry.queries()["r03_monthly_revenue"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate,2001-02-01T06:00)]" in plan


@pytest.mark.parametrize("name", ["r21_product_detail", "r22_order_history", "r30_latest_vendor_lines",
                                  "r31_vendor_top_products"])
def test_per_key_top_n_limits_before_shuffle(spark, name):
    assert "WindowGroupLimit" in plan_of(entry.queries()[name](spark, SF))


@pytest.mark.parametrize("name", ["m10_status_changes", "m11_permission_log", "r34_address_book"])
def test_ordered_walks_are_segmented(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # Every window is either per (key, segment) or over the small per-segment table (ordered by segment).
    assert windows and all("__seg" in w for w in windows), windows


def test_page_children_are_semi_joined_by_broadcast(spark):
    plan = plan_of(entry.queries()["r05_order_search"](spark, SF))
    assert "LeftSemi, BuildRight" in plan and "BroadcastExchange" in plan
