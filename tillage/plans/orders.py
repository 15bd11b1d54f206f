"""Customer-side order reports: order history, order document, cart totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.functions.exprs import money_round
from tillage.operators import filters as flt
from tillage.operators.aggregates import MONEY
from tillage.operators.joins import child_array, primary_image, scalar
from tillage.operators.paging import top_n_per_key
from tillage.plans.common import Registered, digest
from tillage.sources.fixtures import Catalog, with_fixtures
from tillage.sources.literals import delivery_settings, seed_settings

HISTORY_PAGE = 10
ITEM_FIELDS = ["product_id", "line_no", "quantity", "total", "product_name"]


def _named_items(order_items: DataFrame, products: DataFrame) -> DataFrame:
    names = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    return order_items.join(names, "product_id")


# R22 ------------------------------------------------------------------------------
def order_history(orders: DataFrame, order_items: DataFrame, products: DataFrame, status: str = "",
                  page_no: int = 1, customer_id=None) -> DataFrame:
    """Every customer's (or one customer's) order page: newest first, 10 per page,
    with item_count and items[]; the page is numbered per customer.

    The page is chosen per customer (top-n); the chosen orders' lines (a semi
    join) are aggregated per order into ``item_count`` (every line, ``COUNT(oi.id)``) and
    ``items[]`` (lines whose product exists, as the reference's inner join)
    and joined 1:1 to the chosen orders.
    """
    o = flt.where_all(orders, [flt.optional(status, lambda v: F.col("order_status") == F.lit(str(v).lower())),
                               None if customer_id is None else F.col("customer_id") == F.lit(customer_id)])
    ranked = top_n_per_key(o, ["customer_id"], [F.col("created_at").desc(), F.col("id").desc()],
                           page_no * HISTORY_PAGE, rank_col="__rn")
    chosen = ranked.where(F.col("__rn") > (page_no - 1) * HISTORY_PAGE).drop("__rn")
    names = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"),
                            F.lit(True).alias("__known"))
    # Only the chosen orders' lines are named, collected and shuffled on.
    wanted = order_items.join(chosen.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    lines = wanted.join(names, "product_id", "left")
    elem = F.when(F.col("__known"), F.struct(*[F.col(c) for c in ITEM_FIELDS]))
    # Per-order aggregates first (partial in every map task), then a 1:1 join.
    per_order = lines.groupBy(F.col("order_id").alias("__oid")).agg(
        F.count(F.lit(1)).alias("item_count"), F.array_sort(F.collect_list(elem)).alias("items"))
    out = chosen.join(per_order, chosen.id == per_order.__oid, "left").drop("__oid")
    empty = F.array().cast(per_order.schema["items"].dataType)
    return out.select(*chosen.columns, F.coalesce("item_count", F.lit(0)).cast("bigint").alias("item_count"),
                      F.coalesce("items", empty).alias("items"))


# R23 ------------------------------------------------------------------------------
def order_documents(orders: DataFrame, order_items: DataFrame, products: DataFrame, payments: DataFrame,
                    addresses: DataFrame) -> DataFrame:
    """Each order as one document: order columns + items[] + payment{} + address{}."""
    docs = child_array(orders, _named_items(order_items, products), "id", "order_id", ITEM_FIELDS, "items")
    pay_cols = [c for c in payments.columns if c != "order_id"]
    pay = payments.select(F.col("order_id").alias("__po"), F.struct(*pay_cols).alias("payment"))
    addr_cols = [c for c in addresses.columns if c != "id"]
    addr = addresses.select(F.col("id").alias("__ad"), F.struct(F.col("id"), *addr_cols).alias("address"))
    return (docs.join(pay, docs.id == pay.__po, "left").join(addr, docs.address_id == addr.__ad, "left")
            .drop("__po", "__ad"))


# R24 ------------------------------------------------------------------------------
def cart_totals(cart: DataFrame, products: DataFrame, vendors: DataFrame, images: DataFrame,
                settings: DataFrame) -> DataFrame:
    """Per customer: subtotal, mrp_total, savings, delivery (free at the threshold), total,
    item_count and items[]; inactive products are left out as in the reference."""
    rule = scalar(delivery_settings(settings).select(F.struct(
        F.col("free_threshold").cast(MONEY).alias("t"), F.col("delivery_charge").cast(MONEY).alias("c"))))
    threshold, charge = rule["t"], rule["c"]
    pr = products.where(F.col("is_active")).select(F.col("id").alias("product_id"), "name", "selling_price",
                                                   "mrp", "stock_qty", "vendor_id")
    v = vendors.select(F.col("id").alias("vendor_id"), F.col("business_name").alias("vendor_name"))
    img = primary_image(images).withColumnRenamed("image_url", "image")
    lines = cart.join(pr, "product_id").join(v, "vendor_id").join(img, "product_id", "left")
    g = lines.groupBy("customer_id").agg(
        F.sum(F.col("selling_price") * F.col("quantity")).cast(MONEY).alias("__sub"),
        F.sum(F.col("mrp") * F.col("quantity")).cast(MONEY).alias("__mrp"),
        F.count(F.lit(1)).alias("item_count"),
        F.array_sort(F.collect_list(F.struct("product_id", "quantity", "name", "selling_price", "mrp",
                                             "image", "vendor_name"))).alias("items"))
    delivery = F.when(F.col("__sub") >= threshold, F.lit(0).cast(MONEY)).otherwise(charge)
    return g.select("customer_id",
                    money_round("__sub").alias("subtotal"),
                    money_round("__mrp").alias("mrp_total"),
                    money_round(F.col("__mrp") - F.col("__sub")).alias("savings"),
                    delivery.alias("delivery"),
                    money_round(F.col("__sub") + delivery).alias("total"),
                    "item_count", threshold.alias("free_threshold"), "items")


# ---------------------------------------------------------------------------------------
ITEMS_SQL = """(SELECT count(*) FROM fx_order_items oi WHERE oi.order_id={oid}) AS item_count,
  (SELECT coalesce(string_agg(concat_ws('|', oi.product_id, oi.line_no, oi.quantity, oi.total, p.name), ';'
     ORDER BY concat_ws('|', oi.product_id, oi.line_no, oi.quantity, oi.total, p.name)), '')
   FROM fx_order_items oi JOIN fx_products p ON oi.product_id=p.id WHERE oi.order_id={oid}) AS items"""


def _r22(c: Catalog) -> DataFrame:
    df = order_history(c.orders, c.order_items, c.products, status="")
    return df.select("customer_id", "id", "final_amount", "payment_status", "order_status", "created_at",
                     "item_count", digest("items", ITEM_FIELDS).alias("items"))


def _r22_page2(c: Catalog) -> DataFrame:
    df = order_history(c.orders, c.order_items, c.products, page_no=2)
    return df.select("customer_id", "id", "final_amount", "payment_status", "order_status", "created_at",
                     "item_count", digest("items", ITEM_FIELDS).alias("items"))


def _r23(c: Catalog) -> DataFrame:
    df = order_documents(c.orders, c.order_items, c.products, c.payments, c.addresses)
    return df.select("id", "customer_id", "final_amount", "payment_status", "order_status", "created_at",
                     F.size("items").cast("bigint").alias("item_count"), digest("items", ITEM_FIELDS).alias("items"),
                     F.col("payment.payment_method").alias("payment_method"),
                     F.col("payment.amount").alias("payment_amount"),
                     F.col("address.city").alias("city"), F.col("address.state").alias("state"))


def _r24(c: Catalog) -> DataFrame:
    df = cart_totals(c.cart, c.products, c.vendors, c.product_images, seed_settings(c.spark))
    return df.select("customer_id", "subtotal", "mrp_total", "savings", "delivery", "total", "item_count",
                     "free_threshold",
                     digest("items", ["product_id", "quantity", "selling_price", "image"]).alias("items"))


REGISTRY = [
    Registered(
        "r22_order_history",
        _r22,
        with_fixtures(f"""WITH r AS (SELECT o.*, row_number() OVER (PARTITION BY customer_id
    ORDER BY created_at DESC, id DESC) AS rn FROM fx_orders o)
SELECT r.customer_id, r.id, r.final_amount, r.payment_status, r.order_status, r.created_at,
  {ITEMS_SQL.format(oid='r.id')}
FROM r WHERE rn <= 10""", "fx_orders", "fx_order_items", "fx_products")),
    Registered(
        "r22_order_history_page2",
        _r22_page2,
        with_fixtures(f"""WITH r AS (SELECT o.*, row_number() OVER (PARTITION BY customer_id
    ORDER BY created_at DESC, id DESC) AS rn FROM fx_orders o)
SELECT r.customer_id, r.id, r.final_amount, r.payment_status, r.order_status, r.created_at,
  {ITEMS_SQL.format(oid='r.id')}
FROM r WHERE rn BETWEEN 11 AND 20""", "fx_orders", "fx_order_items", "fx_products")),
    Registered(
        "r23_order_documents",
        _r23,
        with_fixtures(f"""SELECT o.id, o.customer_id, o.final_amount, o.payment_status, o.order_status, o.created_at,
  {ITEMS_SQL.format(oid='o.id')}, pm.payment_method, pm.amount AS payment_amount, a.city, a.state
FROM fx_orders o LEFT JOIN fx_payments pm ON pm.order_id=o.id LEFT JOIN fx_addresses a ON o.address_id=a.id""",
                      "fx_orders", "fx_order_items", "fx_products", "fx_payments", "fx_addresses")),
    Registered(
        "r24_cart_totals",
        _r24,
        with_fixtures("""WITH l AS (
  SELECT c.customer_id, c.product_id, c.quantity, p.selling_price, p.mrp,
    (SELECT image_url FROM fx_product_images i WHERE i.product_id=p.id AND i.is_primary
     ORDER BY i.sort_order, i.id LIMIT 1) AS image
  FROM fx_cart c JOIN fx_products p ON c.product_id=p.id JOIN fx_vendors v ON p.vendor_id=v.id
  WHERE p.is_active),
g AS (SELECT customer_id, CAST(sum(selling_price * quantity) AS DECIMAL(38,2)) AS sub,
  CAST(sum(mrp * quantity) AS DECIMAL(38,2)) AS mrp, count(*) AS item_count,
  string_agg(concat_ws('|', product_id, quantity, selling_price, image), ';'
    ORDER BY concat_ws('|', product_id, quantity, selling_price, image)) AS items
  FROM l GROUP BY customer_id)
SELECT customer_id, sub AS subtotal, mrp AS mrp_total, CAST(mrp - sub AS DECIMAL(38,2)) AS savings,
  CAST(CASE WHEN sub >= 499 THEN 0 ELSE 49 END AS DECIMAL(38,2)) AS delivery,
  CAST(sub + CASE WHEN sub >= 499 THEN 0 ELSE 49 END AS DECIMAL(38,2)) AS total, item_count,
  CAST(499 AS DECIMAL(38,2)) AS free_threshold, items
FROM g""", "fx_cart", "fx_products", "fx_vendors", "fx_product_images")),
]
