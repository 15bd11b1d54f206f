"""Vendor reports: newest vendors, KPIs, latest lines, top products, monthly revenue."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.functions.exprs import to_char, trunc_ts
from tillage.operators import filters as flt
from tillage.operators.aggregates import MONEY
from tillage.operators.changes import stock_ledger
from tillage.operators.joins import primary_image
from tillage.operators.paging import top_k, top_n_per_key
from tillage.plans.common import AS_OF, Registered, ts_lit
from tillage.sources.fixtures import Catalog, with_fixtures

VARIANTS = ("as_written", "corrected")
LINES_A_TASK = 200_000  # of the join to the orders and the count of distinct ones, whose memory grows with a task's lines


# R28 ----------------------------------------------------------------------------
def newest_vendors(vendors: DataFrame, n: int = 20) -> DataFrame:
    cols = [c for c in ("id", "vendor_code", "business_name", "owner_name", "city", "state", "is_verified")
            if c in vendors.columns]
    return top_k(vendors.where(F.col("status") == "approved"),
                 [F.col("created_at").desc(), F.col("id").desc()], n).select(*cols)


# R29 ----------------------------------------------------------------------------
def vendor_kpis(vendors: DataFrame, order_items: DataFrame, orders: DataFrame, products: DataFrame,
                reviews: DataFrame, variant: str = "corrected") -> DataFrame:
    """Per vendor: paid revenue, distinct orders, active products, average rating.

    ``as_written`` keeps the reference's join: every order line is repeated
    once per review of its product, which multiplies revenue by the review
    count and weights the rating by order lines. It is computed from
    per-product review aggregates (n, sum) -- revenue x greatest(n, 1),
    rating = sum(line's rating sum) / sum(line's n) -- so the line x review
    product is never built. ``corrected`` counts each line and each review once.
    """
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")
    pr = products.select(F.col("id").alias("product_id"), "vendor_id")
    paid = orders.select(F.col("id").alias("order_id"), (F.col("payment_status") == "paid").alias("__paid"))
    # Lines and orders meet in as many tasks as the lines need, whatever the session's number; the distinct count stays in them.
    tasks = order_items.count() // LINES_A_TASK + 1
    paid = paid.where(F.col("order_id").isNotNull()).repartition(tasks, "order_id")
    lines = order_items.where(F.col("order_id").isNotNull()).select("order_id", "product_id", "total").join(pr, "product_id")
    rv = reviews.groupBy("product_id").agg(F.count(F.lit(1)).alias("__n"), F.sum("rating").alias("__s"))
    line_money = F.when(F.col("__paid"), F.col("total")).otherwise(F.lit(0))
    if variant == "as_written":
        lines = lines.join(rv, "product_id", "left").drop("product_id").repartition(tasks, "order_id").join(paid, "order_id")
        fan = F.greatest(F.coalesce(F.col("__n"), F.lit(0)), F.lit(1))
        per = lines.groupBy("vendor_id").agg(
            F.sum(line_money * fan).alias("__rev"),
            F.count_distinct("order_id").alias("total_orders"),
            (F.sum(F.col("__s")) / F.sum(F.col("__n"))).alias("__avg"))
    else:
        lines = lines.drop("product_id").repartition(tasks, "order_id").join(paid, "order_id")
        per = lines.groupBy("vendor_id").agg(F.sum(line_money).alias("__rev"),
                                             F.count_distinct("order_id").alias("total_orders"))
        rated = (rv.join(pr, "product_id").groupBy("vendor_id")
                 .agg((F.sum("__s") / F.sum("__n")).alias("__avg")))
        per = per.join(rated, "vendor_id", "full")
    active = (products.where(F.col("is_active")).groupBy("vendor_id")
              .agg(F.count(F.lit(1)).alias("total_products")))
    v = vendors.select(F.col("id").alias("vendor_id"))
    j = v.join(per, "vendor_id", "left").join(active, "vendor_id", "left")
    return j.select(
        "vendor_id",
        F.coalesce(F.col("__rev"), F.lit(0)).cast(MONEY).alias("total_revenue"),
        F.coalesce(F.col("total_orders"), F.lit(0)).cast("bigint").alias("total_orders"),
        F.coalesce(F.col("total_products"), F.lit(0)).cast("bigint").alias("total_products"),
        F.coalesce(F.col("__avg"), F.lit(0.0)).cast("double").cast("decimal(18,6)").alias("avg_rating"))


# R30 ----------------------------------------------------------------------------
def latest_vendor_lines(order_items: DataFrame, orders: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` latest order lines of every vendor (all output columns break ties)."""
    pr = products.select(F.col("id").alias("product_id"), "vendor_id", F.col("name").alias("product_name"))
    o = orders.select(F.col("id").alias("order_id"), "created_at", "payment_status")
    lines = order_items.join(pr, "product_id").join(o, "order_id")
    order = [F.col("created_at").desc(), F.col("order_id").desc(), F.col("line_no").asc(),
             F.col("product_id").asc(), F.col("quantity").asc(), F.col("total").asc()]
    top = top_n_per_key(lines, ["vendor_id"], order, n)
    return top.select("vendor_id", "order_id", "line_no", "quantity", "total", "product_name", "created_at",
                      "payment_status")


# R31 ----------------------------------------------------------------------------
def vendor_top_products(products: DataFrame, images: DataFrame, n: int = 5) -> DataFrame:
    """Top ``n`` active products of every vendor by ``sold_count``, with a primary image."""
    active = products.where(F.col("is_active"))
    top = top_n_per_key(active, ["vendor_id"], [F.col("sold_count").desc(), F.col("id").asc()], n)
    img = primary_image(images).withColumnRenamed("image_url", "image")
    return (top.join(img, top.id == img.product_id, "left")
            .select("vendor_id", "id", "name", "selling_price", "stock_qty", "sold_count", "image"))


# R32 ----------------------------------------------------------------------------
def vendor_monthly_revenue(order_items: DataFrame, orders: DataFrame, products: DataFrame,
                           as_of: dt.datetime = AS_OF, months: int = 6) -> DataFrame:
    """Paid revenue per vendor and month, trailing ``months`` (valid GROUP BY form)."""
    o = (orders.where((F.col("payment_status") == "paid") & flt.trailing("created_at", as_of, months=months))
         .select(F.col("id").alias("order_id"), "created_at"))
    pr = products.select(F.col("id").alias("product_id"), "vendor_id")
    lines = order_items.join(o, "order_id").join(pr, "product_id")
    g = lines.groupBy("vendor_id", trunc_ts("created_at", "month").alias("__m"))
    return (g.agg(F.sum("total").cast(MONEY).alias("revenue")).orderBy("vendor_id", "__m")
            .select("vendor_id", to_char("__m", "Mon YYYY").alias("month"), "revenue"))


# ---------------------------------------------------------------------------------------
SIX_MONTHS = ts_lit(dt.datetime(2001, 2, 1, 6, 0, 0))

R29_SQL = {
    "as_written": """WITH x AS (
  SELECT p.vendor_id, oi.order_id, CASE WHEN o.payment_status='paid' THEN oi.total ELSE 0 END AS m, r.rating
  FROM fx_order_items oi JOIN fx_orders o ON oi.order_id=o.id JOIN fx_products p ON oi.product_id=p.id
  LEFT JOIN fx_reviews r ON r.product_id=p.id),
a AS (SELECT vendor_id, sum(m) AS rev, count(DISTINCT order_id) AS n, avg(rating) AS avg_rating FROM x GROUP BY vendor_id)""",
    "corrected": """WITH x AS (
  SELECT p.vendor_id, oi.order_id, CASE WHEN o.payment_status='paid' THEN oi.total ELSE 0 END AS m
  FROM fx_order_items oi JOIN fx_orders o ON oi.order_id=o.id JOIN fx_products p ON oi.product_id=p.id),
rr AS (SELECT p.vendor_id, avg(r.rating) AS avg_rating FROM fx_reviews r JOIN fx_products p ON r.product_id=p.id
  GROUP BY p.vendor_id),
a AS (SELECT x.vendor_id, sum(m) AS rev, count(DISTINCT order_id) AS n, any_value(rr.avg_rating) AS avg_rating
  FROM x LEFT JOIN rr ON rr.vendor_id=x.vendor_id GROUP BY x.vendor_id)""",
}


def _r29_sql(variant: str) -> str:
    body = R29_SQL[variant] + """
SELECT v.id AS vendor_id, CAST(coalesce(a.rev, 0) AS DECIMAL(38,2)) AS total_revenue,
  coalesce(a.n, 0) AS total_orders,
  (SELECT count(*) FROM fx_products p WHERE p.vendor_id=v.id AND p.is_active) AS total_products,
  CAST(CAST(coalesce(a.avg_rating, """ + ("(SELECT avg(r.rating) FROM fx_reviews r JOIN fx_products p ON r.product_id=p.id WHERE p.vendor_id=v.id)" if variant == "corrected" else "NULL") + """, 0.0) AS DOUBLE) AS DECIMAL(18,6)) AS avg_rating
FROM fx_vendors v LEFT JOIN a ON a.vendor_id=v.id"""
    return with_fixtures(body, "fx_order_items", "fx_orders", "fx_products", "fx_reviews", "fx_vendors")


def _r31(c: Catalog) -> DataFrame:
    return vendor_top_products(stock_ledger(c.products, c.stock_movements), c.product_images)


REGISTRY = [
    Registered(
        "r28_newest_vendors",
        lambda c: newest_vendors(c.vendors),
        with_fixtures("""SELECT id, business_name, city, state FROM fx_vendors WHERE status='approved'
ORDER BY created_at DESC, id DESC LIMIT 20""", "fx_vendors")),
    Registered("r29_vendor_kpis_as_written",
               lambda c: vendor_kpis(c.vendors, c.order_items, c.orders, c.products, c.reviews, "as_written"),
               _r29_sql("as_written")),
    Registered("r29_vendor_kpis_corrected",
               lambda c: vendor_kpis(c.vendors, c.order_items, c.orders, c.products, c.reviews, "corrected"),
               _r29_sql("corrected")),
    Registered(
        "r30_latest_vendor_lines",
        lambda c: latest_vendor_lines(c.order_items, c.orders, c.products),
        with_fixtures("""SELECT vendor_id, order_id, line_no, quantity, total, product_name, created_at, payment_status
FROM (SELECT p.vendor_id, oi.order_id, oi.line_no, oi.quantity, oi.total, p.name AS product_name, o.created_at,
  o.payment_status, row_number() OVER (PARTITION BY p.vendor_id ORDER BY o.created_at DESC, oi.order_id DESC,
  oi.line_no, oi.product_id, oi.quantity, oi.total) AS rn
  FROM fx_order_items oi JOIN fx_orders o ON oi.order_id=o.id JOIN fx_products p ON oi.product_id=p.id)
WHERE rn <= 10""", "fx_order_items", "fx_orders", "fx_products")),
    Registered(
        "r31_vendor_top_products",
        _r31,
        with_fixtures("""WITH led AS (SELECT product_id, sum(delta) AS net,
    sum(CASE WHEN kind='order' THEN -delta ELSE 0 END) AS sold FROM fx_stock_movements GROUP BY product_id),
pp AS (SELECT p.vendor_id, p.id, p.name, p.selling_price, CAST(p.stock_qty + coalesce(l.net, 0) AS BIGINT) AS stock_qty,
    CAST(coalesce(l.sold, 0) AS BIGINT) AS sold_count
  FROM fx_products p LEFT JOIN led l ON l.product_id=p.id WHERE p.is_active),
r AS (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY sold_count DESC, id) AS rn FROM pp)
SELECT vendor_id, id, name, selling_price, stock_qty, sold_count,
  (SELECT image_url FROM fx_product_images i WHERE i.product_id=r.id AND i.is_primary
   ORDER BY i.sort_order, i.id LIMIT 1) AS image
FROM r WHERE rn <= 5""", "fx_stock_movements", "fx_products", "fx_product_images")),
    Registered(
        "r32_vendor_monthly_revenue",
        lambda c: vendor_monthly_revenue(c.order_items, c.orders, c.products),
        with_fixtures(f"""SELECT p.vendor_id, strftime(date_trunc('month', o.created_at), '%b %Y') AS month,
  CAST(sum(oi.total) AS DECIMAL(38,2)) AS revenue
FROM fx_order_items oi JOIN fx_orders o ON oi.order_id=o.id JOIN fx_products p ON oi.product_id=p.id
WHERE o.payment_status='paid' AND o.created_at >= {SIX_MONTHS}
GROUP BY p.vendor_id, date_trunc('month', o.created_at)""", "fx_order_items", "fx_orders", "fx_products")),
]
