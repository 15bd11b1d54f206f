"""Registered dataset-change jobs (M1-M16) over inputs derived from the test tables.

The change sets below are stand-in inputs: each one only renames event or
order columns into the change schema the job expects.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.functions.exprs import code_from_id
from tillage.operators import changes as ch
from tillage.operators import quality as q
from tillage.operators.merge import KeyedTable
from tillage.operators.paging import latest_per_key
from tillage.operators.pricing import invoice_totals, price_orders
from tillage.operators.search import stored_folder
from tillage.plans.common import AS_OF, Registered
from tillage.sources.fixtures import Catalog, with_fixtures
from tillage.sources.literals import seed_settings


def _events(c: Catalog, kind: str) -> DataFrame:
    return c.base("events").where(F.col("event_type") == kind)


# Stand-in change sets -------------------------------------------------------------------
def cart_changes(c: Catalog) -> DataFrame:
    return _events(c, "purchase").select(F.col("user_id").alias("customer_id"),
                                         (F.col("event_id") % 200).alias("product_id"),
                                         (F.lit(1) + F.col("event_id") % 5).cast("int").alias("quantity"),
                                         F.col("ts").alias("created_at"), F.col("event_id").alias("id"))


def wishlist_adds(c: Catalog) -> DataFrame:
    return _events(c, "view").select(F.col("user_id").alias("customer_id"),
                                     (F.col("event_id") % 200).alias("product_id"),
                                     F.col("ts").alias("created_at"), F.col("event_id").alias("id"))


def product_patches(c: Catalog) -> DataFrame:
    e = _events(c, "error")
    present = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("stock_qty"), F.lit("unit"))) \
        .otherwise(F.array(F.lit("stock_qty")))
    stock = F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("int")).otherwise(F.floor("value").cast("int"))
    return e.select((F.col("event_id") % 200).alias("id"), stock.alias("stock_qty"),
                    F.lit(None).cast("string").alias("unit"), present.alias("present"),
                    F.col("ts").alias("created_at"), F.col("event_id").alias("seq"))


PATCH_SQL = """patches AS (SELECT event_id % 200 AS id,
    CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(floor(value) AS INTEGER) END AS stock_qty, CAST(NULL AS VARCHAR) AS unit,
    CASE WHEN event_id % 3 = 0 THEN ['stock_qty','unit'] ELSE ['stock_qty'] END AS present, ts AS created_at,
    event_id AS seq FROM events WHERE event_type='error')"""


def _on_latest_day(kind: str) -> str:
    return f"event_type='{kind}' AND CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events WHERE event_type='{kind}')"


def _patch_sql(mode: str, events: str = "event_type='error'") -> str:
    def writes(f: str) -> str:
        base = f"list_contains(present, '{f}')"
        return base if mode == "exists" else f"{base} AND {f} IS NOT NULL"

    def latest(f: str) -> str:
        return (f"l_{f} AS (SELECT id, {f} FROM (SELECT id, {f}, row_number() OVER (PARTITION BY id "
                f"ORDER BY created_at DESC, seq DESC) AS rn FROM patches WHERE {writes(f)}) WHERE rn=1)")
    return with_fixtures(f"""WITH {PATCH_SQL.replace("event_type='error'", events)}, {latest('stock_qty')}, {latest('unit')}
SELECT p.id, p.name, p.sku, p.vendor_id, p.category_id, p.mrp, p.selling_price,
  CASE WHEN s.id IS NOT NULL THEN s.stock_qty ELSE p.stock_qty END AS stock_qty, p.is_active,
  CASE WHEN u.id IS NOT NULL THEN u.unit ELSE p.unit END AS unit
FROM fx_products p LEFT JOIN l_stock_qty s ON s.id=p.id LEFT JOIN l_unit u ON u.id=p.id""", "fx_products")


def checkout_requests(c: Catalog) -> DataFrame:
    code = (F.when(F.col("customer_id") % 3 == 0, F.lit(" agro10 "))
            .when(F.col("customer_id") % 3 == 1, F.lit("FIRST50")).otherwise(F.lit(None).cast("string")))
    return c.cart.select("customer_id").distinct().select("customer_id", code.alias("coupon_code"))


def vendor_decisions(c: Catalog) -> DataFrame:
    e = c.base("events").where(F.col("event_type").isin("signup", "error"))
    action = F.when(F.col("event_type") == "signup", "approve").otherwise("reject")
    return e.select(F.col("user_id").alias("vendor_id"), action.alias("action"), F.col("ts").alias("created_at"),
                    F.col("event_id").alias("id"))


def registrations(c: Catalog) -> DataFrame:
    return _events(c, "signup").select(F.col("user_id").alias("id"), F.col("ts").alias("created_at"),
                                       F.col("event_id").alias("seq"))


# Jobs -----------------------------------------------------------------------------------------
def _m01(c: Catalog) -> DataFrame:
    return ch.upsert(c.cart, cart_changes(c), ["customer_id", "product_id"], ["quantity"], ["created_at", "id"])


def _m01_permissions(c: Catalog) -> DataFrame:
    chg = c.permission_changes.select(F.col("target_user").alias("user_id"), "module",
                                      F.col("new_value").alias("granted"), "created_at", "id")
    return ch.upsert(c.user_permissions, chg, ["user_id", "module"], ["granted"], ["created_at", "id"])


def _m02(c: Catalog) -> DataFrame:
    return ch.insert_ignore(c.wishlist, wishlist_adds(c), ["customer_id", "product_id"], order=["created_at", "id"])


def _m03_names(c: Catalog) -> DataFrame:
    return ch.backfill_from(c.order_items, c.products, "product_id", "id", {"product_name": "name"})


def _m03_codes(c: Catalog) -> DataFrame:
    return ch.backfill(c.products, "product_code", code_from_id("PRD-", "id")).select("id", "product_code")


def _m04(c: Catalog) -> DataFrame:
    return ch.add_missing_dependents(c.products, c.inventory, "id", "product_id",
                                     {"current_stock": F.col("stock_qty"),
                                      "low_stock_threshold": F.lit(10).cast("int")})


PLACEHOLDER_IMAGE = "/static/placeholder.png"


def _m04_images(c: Catalog) -> DataFrame:
    """Every product without an image gets one primary placeholder image (sort_order 0)."""
    return ch.add_missing_dependents(c.products, c.product_images, "id", "product_id",
                                     {"image_url": F.lit(PLACEHOLDER_IMAGE), "sort_order": F.lit(0),
                                      "is_primary": F.lit(True)})


def _m05(mode: str):
    def build(c: Catalog) -> DataFrame:
        return ch.sparse_patch(c.products, product_patches(c), "id", ["stock_qty", "unit"],
                               ["created_at", "seq"], mode=mode)
    return build


def _latest_day(changes: DataFrame) -> DataFrame:
    """The changes of the newest day, as a daily batch brings them."""
    day = F.to_date("created_at")
    return changes.where(day == changes.agg(F.max(day)).scalar())


def _m01_touched(c: Catalog) -> DataFrame:
    cart = c.cart
    stored = KeyedTable(stored_folder(c.base("customer"), f"cart-{uuid.uuid4().hex}"), ("customer_id", "product_id")).create(cart)
    changes = _latest_day(cart_changes(c)).withColumns({k: F.col(k).cast(cart.schema[k].dataType) for k in stored.keys})
    stored.merge(changes, lambda cur, chg: ch.upsert(cur, chg, list(stored.keys), ["quantity"], ["created_at", "id"]))
    return stored.read(c.spark)


def _m05_touched(c: Catalog) -> DataFrame:
    products = c.products
    stored = KeyedTable(stored_folder(c.base("part"), f"products-{uuid.uuid4().hex}"), ("id",)).create(products)
    patches = _latest_day(product_patches(c)).withColumn("id", F.col("id").cast(products.schema["id"].dataType))
    stored.merge(patches, lambda cur, chg: ch.sparse_patch(cur, chg, "id", ["stock_qty", "unit"], ["created_at", "seq"], mode="isset"))
    return stored.read(c.spark)


def _m06(c: Catalog) -> DataFrame:
    keys = _events(c, "error").select((F.col("event_id") % 200).alias("id"))
    return ch.soft_delete(c.products, keys, "id").select("id", "is_active")


def _m07(c: Catalog) -> DataFrame:
    req = _events(c, "error").select(F.col("user_id").alias("customer_id"))
    return ch.erase_customers(req, {"orders": c.orders, "reviews": c.reviews},
                              {"cart": c.cart, "wishlist": c.wishlist, "addresses": c.addresses})


def _m08(c: Catalog) -> DataFrame:
    return price_orders(checkout_requests(c), c.cart, c.products, c.coupons, seed_settings(c.spark), AS_OF)


def _m09(c: Catalog) -> DataFrame:
    return ch.stock_ledger(c.products, c.stock_movements).select("id", "stock_qty", "sold_count")


# The CHECK constraints of the final schema (after all migrations).
USER_ROLES = ["customer", "vendor", "admin", "owner", "superadmin"]
PAYMENT_STATUSES = ["pending", "paid", "failed", "refunded"]
ORDER_STATUSES = ["placed", "confirmed", "packed", "shipped", "out_for_delivery", "delivered", "cancelled", "returned"]
VENDOR_STATUSES = ["pending", "approved", "rejected", "suspended"]
DOCUMENT_TYPES = ["AADHAAR", "PAN", "GST_CERTIFICATE", "TRADE_LICENCE", "BUSINESS_REGISTRATION", "BANK_PASSBOOK",
                  "BUSINESS_LOGO", "OTHER"]
SUPPLY_ORDER_STATUSES = ["pending", "confirmed", "dispatched", "delivered", "cancelled"]


def _sql_list(values: list[str]) -> str:
    return ",".join(f"'{v}'" for v in values)


def _m13(c: Catalog) -> DataFrame:
    return q.quality_report({
        "users": (c.users, [q.required("last_name"), q.one_of("role", USER_ROLES)]),
        "customers": (c.customers, [q.required("customer_code")]),
        "orders": (c.orders, [q.one_of("payment_status", PAYMENT_STATUSES),
                              q.one_of("order_status", ORDER_STATUSES)]),
        "vendors": (c.vendors, [q.required("business_name"), q.one_of("status", VENDOR_STATUSES)]),
        "vendor_documents": (c.vendor_documents, [q.one_of("document_type", DOCUMENT_TYPES)]),
        "reviews": (c.reviews, [q.between("rating", 1, 5)]),
        "cnf_orders": (c.cnf_orders, [q.one_of("order_status", SUPPLY_ORDER_STATUSES)]),
    })


def _m15(c: Catalog) -> DataFrame:
    return q.orphan_report({
        "reviews.customer_id": (c.reviews, c.customers, "customer_id"),
        "status_events.order_id": (c.status_events, c.orders, "order_id"),
        "salesmen.distributor_id": (c.salesmen, c.vendors, "distributor_id"),
        "products.category_id": (c.products, c.categories, "category_id"),
        "order_items.product_id": (c.order_items, c.products, "product_id"),
        "product_images.product_id": (c.product_images, c.products, "product_id"),
        "cnf_orders.warehouse_id": (c.cnf_orders, c.warehouses, "warehouse_id"),
    })


def _m14(c: Catalog) -> DataFrame:
    staff = c.users.where(F.col("role") != "customer").select("id")
    return ch.split_duplicates(registrations(c), staff, ["id"], ["created_at", "seq"])


STAT_SQL = """CASE WHEN event_type='signup' THEN 'confirmed' WHEN event_type='view' THEN 'packed'
  WHEN event_type='click' THEN 'shipped' WHEN event_type='purchase' THEN 'delivered' ELSE 'cancelled' END"""

REGISTRY = [
    Registered("m01_touched_partition_upsert", _m01_touched, with_fixtures(f"""WITH l AS (SELECT * FROM (
    SELECT user_id AS customer_id, event_id % 200 AS product_id, CAST(1 + event_id % 5 AS INTEGER) AS quantity,
      row_number() OVER (PARTITION BY user_id, event_id % 200 ORDER BY ts DESC, event_id DESC) AS rn
    FROM events WHERE {_on_latest_day('purchase')}) WHERE rn = 1)
SELECT customer_id, product_id, coalesce(l.quantity, c.quantity) AS quantity
FROM fx_cart c FULL OUTER JOIN l USING (customer_id, product_id)""", "fx_cart")),
    Registered("m05_touched_partition_patch", _m05_touched, _patch_sql("isset", _on_latest_day("error"))),
    Registered("m01_cart_upsert", _m01, with_fixtures("""WITH chg AS (SELECT user_id AS customer_id,
    event_id % 200 AS product_id, CAST(1 + event_id % 5 AS INTEGER) AS quantity, ts AS created_at, event_id AS id
    FROM events WHERE event_type='purchase'),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, product_id
    ORDER BY created_at DESC, id DESC) AS rn FROM chg) WHERE rn=1)
SELECT coalesce(c.customer_id, l.customer_id) AS customer_id, coalesce(c.product_id, l.product_id) AS product_id,
  CASE WHEN l.customer_id IS NOT NULL THEN l.quantity ELSE c.quantity END AS quantity
FROM fx_cart c FULL OUTER JOIN l ON c.customer_id=l.customer_id AND c.product_id=l.product_id""", "fx_cart")),
    Registered("m01_permission_upsert", _m01_permissions, with_fixtures("""WITH l AS (SELECT * FROM (
    SELECT target_user AS user_id, module, new_value AS granted, row_number() OVER (PARTITION BY target_user, module
    ORDER BY created_at DESC, id DESC) AS rn FROM fx_permission_changes) WHERE rn=1)
SELECT coalesce(c.user_id, l.user_id) AS user_id, coalesce(c.module, l.module) AS module,
  CASE WHEN l.user_id IS NOT NULL THEN l.granted ELSE c.granted END AS granted
FROM fx_user_permissions c FULL OUTER JOIN l ON c.user_id=l.user_id AND c.module=l.module""",
                                                                      "fx_user_permissions", "fx_permission_changes")),
    Registered("m02_wishlist_insert_ignore", _m02, with_fixtures("""WITH n AS (SELECT user_id AS customer_id,
    event_id % 200 AS product_id, ts AS created_at, event_id AS id FROM events WHERE event_type='view'),
f AS (SELECT customer_id, product_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, product_id
    ORDER BY created_at, id) AS rn FROM n) WHERE rn=1)
SELECT * FROM fx_wishlist UNION ALL
SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM fx_wishlist w WHERE w.customer_id=f.customer_id
  AND w.product_id=f.product_id)""", "fx_wishlist")),
    Registered("m03_item_name_backfill", _m03_names, with_fixtures("""SELECT oi.*, p.name AS product_name
FROM fx_order_items oi LEFT JOIN fx_products p ON oi.product_id=p.id""", "fx_order_items", "fx_products")),
    Registered("m03_product_code_backfill", _m03_codes, with_fixtures("""SELECT id,
  'PRD-' || upper(substr(CAST(id AS VARCHAR), 1, 8)) AS product_code FROM fx_products""", "fx_products")),
    Registered("m04_inventory_backfill", _m04, with_fixtures("""SELECT * FROM fx_inventory UNION ALL
SELECT p.id AS product_id, p.stock_qty AS current_stock, 10 AS low_stock_threshold FROM fx_products p
WHERE NOT EXISTS (SELECT 1 FROM fx_inventory i WHERE i.product_id=p.id)""", "fx_inventory", "fx_products")),
    Registered("m04_placeholder_images", _m04_images, with_fixtures(f"""SELECT id, product_id, image_url, sort_order,
  is_primary FROM fx_product_images UNION ALL
SELECT CAST(NULL AS BIGINT), p.id, '{PLACEHOLDER_IMAGE}', 0, TRUE FROM fx_products p
WHERE NOT EXISTS (SELECT 1 FROM fx_product_images i WHERE i.product_id=p.id)""", "fx_product_images", "fx_products")),
    Registered("m05_product_patch_exists", _m05("exists"), _patch_sql("exists")),
    Registered("m05_product_patch_isset", _m05("isset"), _patch_sql("isset")),
    Registered("m06_product_soft_delete", _m06, with_fixtures("""SELECT id,
  CASE WHEN id IN (SELECT event_id % 200 FROM events WHERE event_type='error') THEN FALSE ELSE is_active END AS is_active
FROM fx_products""", "fx_products")),
    Registered("m07_customer_erasure", _m07, with_fixtures("""WITH r AS (SELECT DISTINCT user_id AS customer_id
    FROM events WHERE event_type='error'),
x AS (SELECT r.customer_id, (EXISTS (SELECT 1 FROM fx_orders o WHERE o.customer_id=r.customer_id)
    OR EXISTS (SELECT 1 FROM fx_reviews v WHERE v.customer_id=r.customer_id)) AS blocked,
  (SELECT count(*) FROM fx_cart t WHERE t.customer_id=r.customer_id) AS cart_rows,
  (SELECT count(*) FROM fx_wishlist t WHERE t.customer_id=r.customer_id) AS wishlist_rows,
  (SELECT count(*) FROM fx_addresses t WHERE t.customer_id=r.customer_id) AS addresses_rows FROM r)
SELECT *, CASE WHEN blocked THEN 0 ELSE cart_rows + wishlist_rows + addresses_rows END AS rows_removed FROM x""",
                                                          "fx_orders", "fx_reviews", "fx_cart", "fx_wishlist",
                                                          "fx_addresses")),
    Registered("m08_order_pricing", _m08, with_fixtures("""WITH req AS (SELECT DISTINCT customer_id,
    CASE customer_id % 3 WHEN 0 THEN ' agro10 ' WHEN 1 THEN 'FIRST50' ELSE NULL END AS coupon_code FROM fx_cart),
per AS (SELECT c.customer_id, CAST(sum(p.selling_price * c.quantity) AS DECIMAL(38,2)) AS subtotal,
    bool_and(c.quantity <= p.stock_qty) AS ok FROM fx_cart c JOIN fx_products p ON c.product_id=p.id
    WHERE p.is_active GROUP BY c.customer_id),
cp AS (SELECT * FROM fx_coupons WHERE is_active AND valid_from <= TIMESTAMP '2001-08-01 06:00:00'
    AND valid_to >= TIMESTAMP '2001-08-01 06:00:00'),
j AS (SELECT req.customer_id, req.coupon_code, per.subtotal, per.ok, cp.discount_type, cp.discount_value,
    cp.minimum_order_amount, cp.max_discount,
    CASE WHEN per.subtotal IS NULL THEN 'rejected_empty_cart' WHEN NOT per.ok THEN 'rejected_stock' ELSE 'placed' END AS status
  FROM req LEFT JOIN per ON per.customer_id=req.customer_id LEFT JOIN cp ON cp.code=upper(trim(req.coupon_code))),
d AS (SELECT *, CASE WHEN discount_type IS NULL OR subtotal < coalesce(minimum_order_amount, 0) THEN 0
    WHEN discount_type='percentage' THEN CASE WHEN max_discount IS NOT NULL
      THEN least(subtotal * discount_value / 100, max_discount) ELSE subtotal * discount_value / 100 END
    ELSE discount_value END AS disc,
  CASE WHEN subtotal >= 499 THEN 0 ELSE 49 END AS deliv FROM j)
SELECT customer_id, coupon_code, status,
  CASE WHEN status='placed' THEN subtotal END AS subtotal,
  CASE WHEN status='placed' THEN CAST(round(CAST(disc AS DECIMAL(38,6)), 2) AS DECIMAL(38,2)) END AS discount,
  CASE WHEN status='placed' THEN CAST(deliv AS DECIMAL(38,2)) END AS delivery,
  CASE WHEN status='placed' THEN CAST(round(CAST(subtotal - disc + deliv AS DECIMAL(38,6)), 2) AS DECIMAL(38,2)) END AS total,
  (status='placed' AND discount_type IS NOT NULL) AS coupon_used FROM d""",
                                                       "fx_cart", "fx_products", "fx_coupons")),
    Registered("m09_stock_ledger", _m09, with_fixtures("""WITH led AS (SELECT product_id, sum(delta) AS net,
    sum(CASE WHEN kind='order' THEN -delta ELSE 0 END) AS sold FROM fx_stock_movements GROUP BY product_id)
SELECT p.id, CAST(p.stock_qty + coalesce(l.net, 0) AS BIGINT) AS stock_qty, CAST(coalesce(l.sold, 0) AS BIGINT) AS sold_count
FROM fx_products p LEFT JOIN led l ON l.product_id=p.id""", "fx_stock_movements", "fx_products")),
    Registered("m10_status_changes", lambda c: ch.apply_status_events(c.orders, c.status_events),
               with_fixtures("""WITH ev AS (SELECT e.*, o.order_status AS init,
    CASE WHEN e.status='cancelled' THEN 'customer' ELSE 'admin' END AS actor
    FROM fx_status_events e JOIN fx_orders o ON e.order_id=o.id),
e2 AS (SELECT *, (actor='admin' AND status IN ('confirmed','packed','shipped','out_for_delivery','delivered','cancelled'))
    AS admin_ok FROM ev),
e3 AS (SELECT *, sum(CAST(admin_ok AS INTEGER)) OVER w AS run,
    coalesce(last_value(CASE WHEN admin_ok THEN status END IGNORE NULLS) OVER w, init) AS anchor
  FROM e2 WINDOW w AS (PARTITION BY order_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e4 AS (SELECT *, row_number() OVER (PARTITION BY order_id, run, actor='customer' ORDER BY created_at, id) AS nth FROM e3),
e5 AS (SELECT *, admin_ok OR (actor='customer' AND nth=1 AND anchor IN ('placed','confirmed')) AS accepted FROM e4),
per AS (SELECT order_id, count(*) FILTER (WHERE accepted) AS acc, count(*) FILTER (WHERE NOT accepted) AS rej,
    bool_or(accepted AND status='delivered') AS paid FROM e5 GROUP BY order_id),
la AS (SELECT order_id, status FROM (SELECT order_id, status, row_number() OVER (PARTITION BY order_id
    ORDER BY created_at DESC, id DESC) AS rn FROM e5 WHERE accepted) WHERE rn=1)
SELECT o.id, coalesce(la.status, o.order_status) AS order_status,
  CASE WHEN per.paid THEN 'paid' ELSE o.payment_status END AS payment_status,
  CAST(coalesce(per.acc, 0) AS BIGINT) AS accepted_events, CAST(coalesce(per.rej, 0) AS BIGINT) AS rejected_events
FROM fx_orders o LEFT JOIN per ON per.order_id=o.id LEFT JOIN la ON la.order_id=o.id""",
                             "fx_status_events", "fx_orders")),
    Registered("m10_vendor_decisions", lambda c: ch.apply_vendor_decisions(c.vendors, vendor_decisions(c)),
               with_fixtures("""WITH d AS (SELECT user_id AS vendor_id,
    CASE event_type WHEN 'signup' THEN 'approve' ELSE 'reject' END AS action, ts AS created_at, event_id AS id
    FROM events WHERE event_type IN ('signup','error')),
r AS (SELECT *, row_number() OVER (PARTITION BY vendor_id, action ORDER BY created_at, id) AS rn_first,
    row_number() OVER (PARTITION BY vendor_id, action ORDER BY created_at DESC, id DESC) AS rn_last FROM d),
per AS (SELECT vendor_id,
    max(CASE WHEN action='approve' AND rn_first=1 THEN created_at END) AS ok_ts,
    max(CASE WHEN action='approve' AND rn_first=1 THEN id END) AS ok_id,
    max(CASE WHEN action='reject' AND rn_first=1 THEN created_at END) AS fno_ts,
    max(CASE WHEN action='reject' AND rn_first=1 THEN id END) AS fno_id,
    max(CASE WHEN action='reject' AND rn_last=1 THEN created_at END) AS lno_ts,
    max(CASE WHEN action='reject' AND rn_last=1 THEN id END) AS lno_id,
    count(*) FILTER (WHERE action='reject') AS n_no, count(*) AS n_all FROM r GROUP BY vendor_id),
j AS (SELECT v.*, per.*, (v.status='pending' AND per.ok_ts IS NOT NULL AND (per.fno_ts IS NULL
      OR per.ok_ts < per.fno_ts OR (per.ok_ts = per.fno_ts AND per.ok_id < per.fno_id))) AS ok_applies
    FROM fx_vendors v LEFT JOIN per ON per.vendor_id=v.id)
SELECT id, business_name, city, state, created_at,
  CASE WHEN ok_applies AND (lno_ts IS NULL OR ok_ts > lno_ts OR (ok_ts = lno_ts AND ok_id > lno_id)) THEN 'approved'
       WHEN lno_ts IS NOT NULL THEN 'rejected' ELSE status END AS status,
  CASE WHEN ok_applies THEN 'VND-' || upper(substr(CAST(id AS VARCHAR), 1, 8)) END AS vendor_code,
  CAST(coalesce(n_no, 0) + CASE WHEN ok_applies THEN 1 ELSE 0 END AS BIGINT) AS applied_decisions,
  CAST(coalesce(n_all, 0) - coalesce(n_no, 0) - CASE WHEN ok_applies THEN 1 ELSE 0 END AS BIGINT) AS refused_decisions
FROM j""", "fx_vendors")),
    Registered("m11_permission_log", lambda c: ch.permission_log(c.permission_changes),
               with_fixtures("""SELECT id, changed_by, target_user, regexp_replace(lower(module), '[^a-z0-9_]', '', 'g') AS module,
  CASE WHEN prev IS NULL THEN NULL WHEN prev THEN 'TRUE' ELSE 'FALSE' END AS old_value,
  CASE WHEN new_value THEN 'TRUE' ELSE 'FALSE' END AS new_value, created_at
FROM (SELECT *, lag(new_value) OVER (PARTITION BY target_user, regexp_replace(lower(module), '[^a-z0-9_]', '', 'g')
  ORDER BY created_at, id) AS prev FROM fx_permission_changes)""", "fx_permission_changes")),
    Registered("m12_invoice_totals", lambda c: invoice_totals(c.supply_items),
               with_fixtures("""SELECT order_id, count(*) AS line_count,
  CAST(sum(coalesce(quantity, 1) * coalesce(unit_price, 0)) AS DECIMAL(38,2)) AS total_amount
FROM fx_supply_items GROUP BY order_id""", "fx_supply_items")),
    Registered("m13_quality_report", _m13, with_fixtures(f"""
SELECT 'users' AS table_name, 'last_name_required' AS rule, 'last_name' AS column_name,
  count(*) FILTER (WHERE NOT coalesce(last_name IS NOT NULL AND CAST(last_name AS VARCHAR) <> '', FALSE)) AS violations,
  count(*) AS checked_rows FROM fx_users
UNION ALL SELECT 'users', 'role_in', 'role', count(*) FILTER (WHERE role IS NOT NULL AND role NOT IN ({_sql_list(USER_ROLES)})), count(*) FROM fx_users
UNION ALL SELECT 'customers', 'customer_code_required', 'customer_code', count(*) FILTER (WHERE customer_code IS NULL OR customer_code = ''), count(*) FROM fx_customers
UNION ALL SELECT 'orders', 'payment_status_in', 'payment_status', count(*) FILTER (WHERE payment_status NOT IN ('pending','paid','failed','refunded')), count(*) FROM fx_orders
UNION ALL SELECT 'orders', 'order_status_in', 'order_status', count(*) FILTER (WHERE order_status NOT IN ('placed','confirmed','packed','shipped','out_for_delivery','delivered','cancelled','returned')), count(*) FROM fx_orders
UNION ALL SELECT 'vendors', 'business_name_required', 'business_name', count(*) FILTER (WHERE business_name IS NULL OR business_name = ''), count(*) FROM fx_vendors
UNION ALL SELECT 'vendors', 'status_in', 'status', count(*) FILTER (WHERE status NOT IN ('pending','approved','rejected','suspended')), count(*) FROM fx_vendors
UNION ALL SELECT 'vendor_documents', 'document_type_in', 'document_type', count(*) FILTER (WHERE document_type NOT IN ({_sql_list(DOCUMENT_TYPES)})), count(*) FROM fx_vendor_documents
UNION ALL SELECT 'reviews', 'rating_range', 'rating', count(*) FILTER (WHERE rating NOT BETWEEN 1 AND 5), count(*) FROM fx_reviews
UNION ALL SELECT 'cnf_orders', 'order_status_in', 'order_status', count(*) FILTER (WHERE order_status NOT IN ('pending','confirmed','dispatched','delivered','cancelled')), count(*) FROM fx_cnf_orders""",
                                                          "fx_users", "fx_customers", "fx_orders", "fx_vendors",
                                                          "fx_vendor_documents", "fx_reviews", "fx_cnf_orders")),
    Registered("m14_registration_split", _m14, with_fixtures("""WITH inc AS (SELECT user_id AS id, ts AS created_at,
    event_id AS seq FROM events WHERE event_type='signup'),
f AS (SELECT id, min((created_at, seq)) AS first FROM inc GROUP BY id)
SELECT inc.*, CASE WHEN inc.id IN (SELECT id FROM fx_users WHERE role <> 'customer') THEN 'exists'
  WHEN (inc.created_at, inc.seq) <> f.first THEN 'duplicate_in_batch' ELSE 'accepted' END AS decision
FROM inc JOIN f ON f.id=inc.id""", "fx_users")),
    Registered("m15_orphan_report", _m15, with_fixtures("""
SELECT 'reviews.customer_id' AS relation, count(*) AS orphan_rows FROM fx_reviews r WHERE r.customer_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_customers c WHERE c.id=r.customer_id)
UNION ALL SELECT 'status_events.order_id', count(*) FROM fx_status_events e WHERE NOT EXISTS (SELECT 1 FROM fx_orders o WHERE o.id=e.order_id)
UNION ALL SELECT 'salesmen.distributor_id', count(*) FROM fx_salesmen s WHERE s.distributor_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_vendors v WHERE v.id=s.distributor_id)
UNION ALL SELECT 'products.category_id', count(*) FROM fx_products p WHERE NOT EXISTS (SELECT 1 FROM fx_categories c WHERE c.id=p.category_id)
UNION ALL SELECT 'order_items.product_id', count(*) FROM fx_order_items i WHERE NOT EXISTS (SELECT 1 FROM fx_products p WHERE p.id=i.product_id)
UNION ALL SELECT 'product_images.product_id', count(*) FROM fx_product_images i WHERE NOT EXISTS (SELECT 1 FROM fx_products p WHERE p.id=i.product_id)
UNION ALL SELECT 'cnf_orders.warehouse_id', count(*) FROM fx_cnf_orders o WHERE o.warehouse_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_warehouses w WHERE w.id=o.warehouse_id)""",
                                                         "fx_reviews", "fx_customers", "fx_status_events", "fx_orders",
                                                         "fx_salesmen", "fx_vendors", "fx_products", "fx_categories",
                                                         "fx_order_items", "fx_product_images", "fx_cnf_orders",
                                                         "fx_warehouses")),
    Registered("l6_latest_order_status",
               lambda c: latest_per_key(c.status_events, "order_id", "created_at", "id", ["status", "created_at"]),
               with_fixtures("""SELECT order_id, status, created_at FROM (SELECT *, row_number() OVER
  (PARTITION BY order_id ORDER BY created_at DESC, id DESC) AS rn FROM fx_status_events) WHERE rn=1""",
                             "fx_status_events")),
    Registered("m16_cart_clamp", lambda c: ch.clamp_cart(c.cart, c.products),
               with_fixtures("""SELECT c.customer_id, c.product_id,
  CAST(greatest(1, least(coalesce(c.quantity, 0), p.stock_qty)) AS INTEGER) AS quantity
FROM fx_cart c JOIN fx_products p ON c.product_id=p.id WHERE p.is_active""", "fx_cart", "fx_products")),
]
