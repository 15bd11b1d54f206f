"""Sales force and supply reports: salesmen, summaries, report rows, order list,
manufacturers and their orders (R35-R39)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.functions.exprs import full_name
from tillage.operators import filters as flt
from tillage.operators.aggregates import sum_or_zero
from tillage.operators.joins import child_array, scalar, through_bridge
from tillage.operators.paging import clamp_page, materialized_page, page
from tillage.plans.common import Registered, digest
from tillage.sources.fixtures import Catalog, with_fixtures

PAGE = 20
VARIANTS = ("as_written", "corrected")


# R35 ------------------------------------------------------------------------------
def salesmen_list(salesmen: DataFrame, vendors: DataFrame, distributor_id=None) -> DataFrame:
    s = flt.where_all(salesmen, [flt.optional(distributor_id, lambda v: F.col("distributor_id") == F.lit(v))])
    v = vendors.select(F.col("id").alias("__v"), F.col("business_name").alias("distributor_name"))
    return s.join(v, s.distributor_id == v.__v, "left").drop("__v").orderBy("name", "id")


def _bridge(salesman_orders: DataFrame, salesmen: DataFrame, orders: DataFrame, date_from, date_to,
            salesman_id=None, distributor_id=None) -> DataFrame:
    """salesman_orders x salesmen x orders with the report's filters (one row per pair)."""
    s = salesmen.select(F.col("id").alias("salesman_id"), F.col("name").alias("salesman_name"), "distributor_id")
    o = orders.select(F.col("id").alias("order_id"), "customer_id", "final_amount", "order_status",
                      "payment_status", "created_at", *[c for c in ("order_number",) if c in orders.columns])
    preds = [flt.between_to_next_midnight("created_at", date_from, date_to)
             if (flt.php_truthy(date_from) and flt.php_truthy(date_to)) else None,
             flt.optional(salesman_id, lambda v: F.col("salesman_id") == F.lit(v)),
             flt.optional(distributor_id, lambda v: F.col("distributor_id") == F.lit(v))]
    return flt.where_all(through_bridge(s, salesman_orders, o, "salesman_id", "order_id"), preds)


# R36 ------------------------------------------------------------------------------
def salesman_summary(salesman_orders: DataFrame, salesmen: DataFrame, orders: DataFrame, date_from: str,
                     date_to: str, salesman_id=None, distributor_id=None, variant: str = "corrected",
                     by_salesman: bool = False) -> DataFrame:
    """Distinct orders, amount and distinct customers in [from, to + 1 day].

    ``as_written`` sums an order's amount once per salesman on it (the join
    fans out); ``corrected`` sums each order once. ``by_salesman`` gives the
    same figures per salesman for every salesman at once.
    """
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")
    b = _bridge(salesman_orders, salesmen, orders, date_from, date_to, salesman_id, distributor_id)
    keys = ["salesman_id"] if by_salesman else []
    if variant == "as_written" or by_salesman:
        amount = sum_or_zero("final_amount")
        return b.groupBy(*keys).agg(F.count_distinct("order_id").alias("total_orders"),
                                    amount.alias("total_amount"),
                                    F.count_distinct("customer_id").alias("total_customers"))
    once = b.select("order_id", "customer_id", "final_amount").dropDuplicates(["order_id"])
    return once.agg(F.count(F.lit(1)).alias("total_orders"), sum_or_zero("final_amount").alias("total_amount"),
                    F.count_distinct("customer_id").alias("total_customers"))


def _named(b: DataFrame, customers: DataFrame, users: DataFrame, vendors: DataFrame) -> DataFrame:
    cu = customers.select(F.col("id").alias("customer_id"), F.col("user_id").alias("__uid"))
    u = users.select(F.col("id").alias("__uid"), "first_name",
                     full_name("first_name", "last_name").alias("customer_name"))
    v = vendors.select(F.col("id").alias("__v"), F.col("business_name").alias("distributor_name"))
    return (b.join(cu, "customer_id").join(u, "__uid")
            .join(v, F.col("distributor_id") == F.col("__v"), "left").drop("__uid", "__v"))


ROW_COLS = ["order_id", "final_amount", "order_status", "payment_status", "created_at", "customer_name",
            "salesman_name", "distributor_name"]


def _row_cols(b: DataFrame) -> list[str]:
    return [*(c for c in ("order_number",) if c in b.columns), *ROW_COLS]


def _row_order() -> list:
    return [F.col("created_at").desc(), F.col("order_id").desc(), F.col("salesman_name").asc_nulls_last(),
            F.col("distributor_name").asc_nulls_last(), F.col("customer_name").asc_nulls_last()]


# R37 ------------------------------------------------------------------------------
def salesman_report_rows(salesman_orders: DataFrame, salesmen: DataFrame, orders: DataFrame,
                         customers: DataFrame, users: DataFrame, vendors: DataFrame, date_from: str,
                         date_to: str, salesman_id=None, distributor_id=None, page_no=1, limit=PAGE) -> DataFrame:
    """Distinct report rows, newest first, one page, with ``total`` = distinct orders."""
    p, lim = clamp_page(page_no, limit, 100)
    b = _bridge(salesman_orders, salesmen, orders, date_from, date_to, salesman_id, distributor_id)
    total = scalar(b.agg(F.count_distinct("order_id")))
    rows = _named(b, customers, users, vendors)
    rows = rows.select(*_row_cols(rows)).distinct()
    return page(rows, _row_order(), p, lim).withColumn("total", total)


# R38 ------------------------------------------------------------------------------
def salesman_order_list(salesman_orders: DataFrame, salesmen: DataFrame, orders: DataFrame,
                        customers: DataFrame, users: DataFrame, vendors: DataFrame, date_from: str = "",
                        date_to: str = "", search: str = "", salesman_id=None, distributor_id=None,
                        page_no=1, limit=PAGE) -> DataFrame:
    """Bridge rows (not distinct) with optional range and search, one page, with ``total``."""
    p, lim = clamp_page(page_no, limit, 100)
    b = _named(_bridge(salesman_orders, salesmen, orders, date_from, date_to, salesman_id, distributor_id),
               customers, users, vendors)
    search = (search or "").strip()
    cols = ["first_name"] + (["order_number"] if "order_number" in b.columns else [])
    b = flt.where_all(b, [flt.optional(search, lambda s: flt.contains_ci(cols, s))])
    total = scalar(b.agg(F.count(F.lit(1))))
    return page(b.select(*_row_cols(b)), _row_order(), p, lim).withColumn("total", total)


# R39 ------------------------------------------------------------------------------
def active_manufacturers(manufacturers: DataFrame) -> DataFrame:
    return manufacturers.where(F.col("is_active")).orderBy("name", "id")


def manufacturer_orders(mo: DataFrame, manufacturers: DataFrame, items: DataFrame, manufacturer_id=None,
                        status: str = "", date: str = "", search: str = "", page_no=1, limit=PAGE) -> DataFrame:
    """Manufacturer orders with filters, newest first, one page with items[] and ``total``."""
    p, lim = clamp_page(page_no, limit, 100)
    search = (search or "").strip()
    m = manufacturers.select(F.col("id").alias("__m"), F.col("name").alias("manufacturer_name"))
    j = mo.join(m, mo.manufacturer_id == m.__m).drop("__m")
    j = flt.where_all(j, [flt.optional(manufacturer_id, lambda v: F.col("manufacturer_id") == F.lit(v)),
                          flt.optional(status, lambda v: F.col("status") == F.lit(v)),
                          flt.optional(date, lambda v: flt.on_day("order_date", v)),
                          flt.optional(search, lambda s: flt.contains_ci(["order_number", "manufacturer_name"], s))])
    total = scalar(j.agg(F.count(F.lit(1))))
    chosen = materialized_page(j, [F.col("order_date").desc(), F.col("id").desc()], p, lim)
    out = child_array(chosen, items, "id", "order_id", ["product_id", "quantity", "unit_price"], "items",
                      parent_bounded=True)
    return out.withColumn("total", total).orderBy(F.col("order_date").desc(), F.col("id").desc())


# ---------------------------------------------------------------------------------------
RANGE = ("2001-01-01", "2001-06-30")
RANGE_SQL = "o.created_at BETWEEN TIMESTAMP '2001-01-01 00:00:00' AND TIMESTAMP '2001-07-01 00:00:00'"
BRIDGE_SQL = """fx_salesman_orders so JOIN fx_salesmen s ON so.salesman_id=s.id JOIN fx_orders o ON so.order_id=o.id"""
NAMED_SQL = BRIDGE_SQL + """ JOIN fx_customers c ON o.customer_id=c.id JOIN fx_users u ON c.user_id=u.id
  LEFT JOIN fx_vendors v ON s.distributor_id=v.id"""
ROW_SQL = """o.id AS order_id, o.final_amount, o.order_status, o.payment_status, o.created_at,
  u.first_name || ' ' || u.last_name AS customer_name, s.name AS salesman_name, v.business_name AS distributor_name"""
ROW_ORDER_SQL = "created_at DESC, order_id DESC, salesman_name NULLS LAST, distributor_name NULLS LAST, customer_name NULLS LAST"
SALES_FX = ("fx_salesman_orders", "fx_salesmen", "fx_orders", "fx_customers", "fx_users", "fx_vendors")


def _r39_orders(c: Catalog, **params) -> DataFrame:
    df = manufacturer_orders(c.manufacturer_orders, c.manufacturers, c.supply_items,
                             **(params or dict(status="pending", search="MFR-1", page_no=1, limit=20)))
    return df.select("id", "manufacturer_id", "order_number", "order_date", "total_amount", "status",
                     "manufacturer_name", F.size("items").cast("bigint").alias("item_count"),
                     digest("items", ["product_id", "quantity", "unit_price"]).alias("items"), "total")


R39_DAY_SQL = """WITH j AS (SELECT mo.*, m.name AS manufacturer_name FROM fx_manufacturer_orders mo
  JOIN fx_manufacturers m ON mo.manufacturer_id=m.id WHERE CAST(mo.order_date AS DATE) = DATE '1999-06-01'),
pg AS (SELECT * FROM j ORDER BY order_date DESC, id DESC LIMIT 100)
SELECT pg.*, (SELECT count(*) FROM fx_supply_items s WHERE s.order_id=pg.id) AS item_count,
  (SELECT coalesce(string_agg(concat_ws('|', s.product_id, s.quantity, s.unit_price), ';'
     ORDER BY concat_ws('|', s.product_id, s.quantity, s.unit_price)), '') FROM fx_supply_items s
   WHERE s.order_id=pg.id) AS items, (SELECT count(*) FROM j) AS total FROM pg"""

REGISTRY = [
    Registered(
        "r39_manufacturer_orders_by_day",
        lambda c: _r39_orders(c, date="1999-06-01", page_no=1, limit=100),
        with_fixtures(R39_DAY_SQL, "fx_manufacturer_orders", "fx_manufacturers", "fx_supply_items")),
    Registered(
        "r35_salesmen",
        lambda c: salesmen_list(c.salesmen, c.vendors),
        with_fixtures("""SELECT s.*, v.business_name AS distributor_name FROM fx_salesmen s
LEFT JOIN fx_vendors v ON s.distributor_id=v.id""", "fx_salesmen", "fx_vendors")),
    Registered(
        "r36_salesman_summary_as_written",
        lambda c: salesman_summary(c.salesman_orders, c.salesmen, c.orders, *RANGE, variant="as_written"),
        with_fixtures(f"""SELECT count(DISTINCT o.id) AS total_orders,
  CAST(coalesce(sum(o.final_amount), 0) AS DECIMAL(38,2)) AS total_amount,
  count(DISTINCT o.customer_id) AS total_customers FROM {BRIDGE_SQL} WHERE {RANGE_SQL}""",
                      "fx_salesman_orders", "fx_salesmen", "fx_orders")),
    Registered(
        "r36_salesman_summary_corrected",
        lambda c: salesman_summary(c.salesman_orders, c.salesmen, c.orders, *RANGE, variant="corrected"),
        with_fixtures(f"""SELECT count(*) AS total_orders, CAST(coalesce(sum(final_amount), 0) AS DECIMAL(38,2)) AS total_amount,
  count(DISTINCT customer_id) AS total_customers
FROM fx_orders o WHERE o.id IN (SELECT so.order_id FROM {BRIDGE_SQL} WHERE {RANGE_SQL})""",
                      "fx_salesman_orders", "fx_salesmen", "fx_orders")),
    Registered(
        "r36_salesman_summary_one_salesman",
        lambda c: salesman_summary(c.salesman_orders, c.salesmen, c.orders, *RANGE, salesman_id=7,
                                   variant="as_written"),
        with_fixtures(f"""SELECT count(DISTINCT o.id) AS total_orders,
  CAST(coalesce(sum(o.final_amount), 0) AS DECIMAL(38,2)) AS total_amount,
  count(DISTINCT o.customer_id) AS total_customers FROM {BRIDGE_SQL} WHERE {RANGE_SQL} AND so.salesman_id = 7""",
                      "fx_salesman_orders", "fx_salesmen", "fx_orders")),
    Registered(
        "r36_salesman_summary_by_salesman",
        lambda c: salesman_summary(c.salesman_orders, c.salesmen, c.orders, *RANGE, by_salesman=True),
        with_fixtures(f"""SELECT so.salesman_id, count(DISTINCT o.id) AS total_orders,
  CAST(coalesce(sum(o.final_amount), 0) AS DECIMAL(38,2)) AS total_amount,
  count(DISTINCT o.customer_id) AS total_customers FROM {BRIDGE_SQL} WHERE {RANGE_SQL} GROUP BY so.salesman_id""",
                      "fx_salesman_orders", "fx_salesmen", "fx_orders")),
    Registered(
        "r37_salesman_report_rows",
        lambda c: salesman_report_rows(c.salesman_orders, c.salesmen, c.orders, c.customers, c.users, c.vendors,
                                       *RANGE, page_no=1, limit=100),
        with_fixtures(f"""WITH r AS (SELECT DISTINCT {ROW_SQL} FROM {NAMED_SQL} WHERE {RANGE_SQL})
SELECT *, (SELECT count(DISTINCT o.id) FROM {BRIDGE_SQL} WHERE {RANGE_SQL}) AS total
FROM r ORDER BY {ROW_ORDER_SQL} LIMIT 100""", *SALES_FX)),
    Registered(
        "r38_salesman_order_list",
        lambda c: salesman_order_list(c.salesman_orders, c.salesmen, c.orders, c.customers, c.users, c.vendors,
                                      date_from="2001-07-01", date_to="2001-07-31", page_no=2, limit=100),
        with_fixtures(f"""WITH r AS (SELECT {ROW_SQL} FROM {NAMED_SQL}
  WHERE o.created_at BETWEEN TIMESTAMP '2001-07-01 00:00:00' AND TIMESTAMP '2001-08-01 00:00:00')
SELECT *, (SELECT count(*) FROM r) AS total FROM r ORDER BY {ROW_ORDER_SQL} LIMIT 100 OFFSET 100""", *SALES_FX)),
    Registered(
        "r38_salesman_order_list_search",
        lambda c: salesman_order_list(c.salesman_orders, c.salesmen, c.orders, c.customers, c.users, c.vendors,
                                      search="ser", distributor_id=3, page_no=1, limit=50),
        with_fixtures(f"""WITH r AS (SELECT {ROW_SQL} FROM {NAMED_SQL}
  WHERE s.distributor_id = 3 AND u.first_name ILIKE '%ser%')
SELECT *, (SELECT count(*) FROM r) AS total FROM r ORDER BY {ROW_ORDER_SQL} LIMIT 50""", *SALES_FX)),
    Registered(
        "r39_manufacturers",
        lambda c: active_manufacturers(c.manufacturers),
        with_fixtures("SELECT * FROM fx_manufacturers WHERE is_active", "fx_manufacturers")),
    Registered(
        "r39_manufacturer_orders",
        _r39_orders,
        with_fixtures("""WITH j AS (SELECT mo.*, m.name AS manufacturer_name FROM fx_manufacturer_orders mo
  JOIN fx_manufacturers m ON mo.manufacturer_id=m.id
  WHERE mo.status='pending' AND (mo.order_number ILIKE '%MFR-1%' OR m.name ILIKE '%MFR-1%')),
pg AS (SELECT * FROM j ORDER BY order_date DESC, id DESC LIMIT 20)
SELECT pg.*, (SELECT count(*) FROM fx_supply_items s WHERE s.order_id=pg.id) AS item_count,
  (SELECT coalesce(string_agg(concat_ws('|', s.product_id, s.quantity, s.unit_price), ';'
     ORDER BY concat_ws('|', s.product_id, s.quantity, s.unit_price)), '') FROM fx_supply_items s
   WHERE s.order_id=pg.id) AS items, (SELECT count(*) FROM j) AS total FROM pg""",
                      "fx_manufacturer_orders", "fx_manufacturers", "fx_supply_items")),
]
