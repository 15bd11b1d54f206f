"""Reports answered from stored daily partials: R03, R10, R11, R13, R18 and R36's distinct counts.

The stored partials come from two refreshes that together take in every order:
the orders of closed days but for late ones, then all others.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tillage.operators.filters import ntz
from tillage.operators.rollups import DailyRollups
from tillage.operators.search import is_stored, stored_folder
from tillage.plans import admin, depot
from tillage.plans.common import AS_OF, Registered
from tillage.sources.fixtures import with_fixtures

LAST_CLOSED = dt.datetime(2001, 7, 1)
RANGES = [(dt.date(2001, 7, 1), dt.date(2001, 7, 31)), (dt.date(2001, 1, 1), dt.date(2001, 12, 31)),
          (dt.date(1992, 1, 1), dt.date(2010, 1, 1)), (dt.date(2001, 7, 15), dt.date(2001, 7, 15))]


def _batches(orders):
    """Orders of closed days that came in time, then new ones and, late, those still ``placed``; an order is in one of them."""
    first = F.coalesce((F.col("created_at") < ntz(LAST_CLOSED)) & (F.col("order_status") != "placed"), F.lit(False))
    return [("1", orders.where(first)), ("2", orders.where(~first))]


def stored_rollups(c) -> DailyRollups:
    """The partials of these orders and lines; written in two refreshes if there are none of these files yet."""
    path = f"{stored_folder(c.base('orders'), 'rollups')}-{stored_folder(c.base('lineitem'), 'lines').rsplit('-', 1)[1]}"
    rollups = DailyRollups(path)
    if not is_stored(c.spark, path, "sales_ids/batch=2"):
        for batch, orders in _batches(c.orders):
            rollups.refresh(batch, orders, c.order_items)
            rollups.refresh_salesmen(batch, c.salesman_orders, orders)
    return rollups


def _direct(module, name: str) -> str:
    return next(r.sql for r in module.REGISTRY if r.name == name)


def _ranges_sql(by_salesman: bool) -> str:
    key, group = ("salesman_id, ", " GROUP BY salesman_id") if by_salesman else ("", " HAVING count(*) > 0")
    return " UNION ALL ".join(
        f"SELECT DATE '{a}' AS date_from, DATE '{b}' AS date_to, {key}count(DISTINCT order_id) AS total_orders, "
        f"count(DISTINCT customer_id) AS total_customers FROM served WHERE created_at >= TIMESTAMP '{a} 00:00:00' "
        f"AND created_at <= TIMESTAMP '{b + dt.timedelta(days=1)} 00:00:00'{group}" for a, b in RANGES)


def _served(body: str) -> str:
    return with_fixtures(f"""SELECT * FROM (WITH served AS (SELECT s.salesman_id, s.order_id, o.customer_id, o.created_at
FROM fx_salesman_orders s JOIN fx_orders o ON o.id = s.order_id) {body})""", "fx_salesman_orders", "fx_orders")


REGISTRY = [
    Registered("r03_monthly_revenue_stored", lambda c: stored_rollups(c).monthly_revenue(c.orders, AS_OF).drop("month_start"),
               _direct(admin, "r03_monthly_revenue")),
    Registered("r10_monthly_sales_stored", lambda c: stored_rollups(c).monthly_sales(c.orders, AS_OF), _direct(admin, "r10_monthly_sales")),
    Registered("r11_daily_sales_stored", lambda c: stored_rollups(c).daily_sales(c.orders, AS_OF), _direct(admin, "r11_daily_sales")),
    Registered("r13_revenue_summary_stored", lambda c: stored_rollups(c).revenue_summary(c.orders), _direct(admin, "r13_revenue_summary")),
    Registered("r18_fast_moving_stored",
               lambda c: stored_rollups(c).fast_moving(c.products, c.categories, (AS_OF - dt.timedelta(days=30)).date(), AS_OF.date()),
               _direct(depot, "r18_fast_moving")),
    Registered("r36_distinct_sales_stored", lambda c: stored_rollups(c).distinct_sales(c.spark, RANGES), _served(_ranges_sql(False))),
    Registered("r36_distinct_sales_by_salesman_stored", lambda c: stored_rollups(c).distinct_sales(c.spark, RANGES, by_salesman=True),
               _served(_ranges_sql(True))),
]
