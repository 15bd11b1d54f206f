"""
registers on its own (filters F, joins J, aggregates A, ordering L, scalar
functions E). Each runs a library operator over a whole stand-in table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.functions import exprs as E
from tillage.operators import aggregates as A
from tillage.operators import filters as flt
from tillage.operators import joins as J
from tillage.operators.paging import clamp_page, page_meta, pg_asc, pg_desc, top_k
from tillage.plans.common import AS_OF, Registered, ts_lit
from tillage.sources.fixtures import Catalog, with_fixtures

NOW = ts_lit(AS_OF)


def _count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


# Filters ------------------------------------------------------------------------------
def _f01(c: Catalog) -> DataFrame:
    params = {"status": "delivered", "category_id": "", "date": "0"}  # '' and '0' are falsy: no predicate
    preds = [flt.optional(params["status"], lambda v: F.col("order_status") == v),
             flt.optional(params["category_id"], lambda v: F.col("category_id") == v),
             flt.optional(params["date"], lambda v: flt.on_day("created_at", v))]
    return _count(flt.where_all(c.orders, preds), "payment_status")


def _f02(c: Catalog) -> DataFrame:
    p = c.products.where(flt.equals("vendor_id", 3) & flt.equals("is_active", True))
    return p.agg(F.count(F.lit(1)).alias("n"), F.sum("stock_qty").alias("stock"))


def _f13(c: Catalog) -> DataFrame:
    """Banners live on a day: each shows for 30 days from its creation date."""
    b = c.banners.withColumn("valid_to", F.date_add("created_at", 30))
    live_on = AS_OF.replace(year=2024, month=3, day=1)
    return b.where(flt.valid_at(F.col("created_at").cast("timestamp_ntz"),
                                F.col("valid_to").cast("timestamp_ntz"), live_on)).select("id", "created_at")


def _f03(c: Catalog) -> DataFrame:
    hit = flt.contains_ci(["last_name", "customer_code"], "0_1")  # '_' stays a one-character wildcard
    return c.customers.where(hit).select("id", "customer_code")


def _f05(c: Catalog) -> DataFrame:
    return c.products.where(flt.price_range("selling_price", 950, "1000.5")).select("id", "selling_price")


def _f06(c: Catalog) -> DataFrame:
    return _count(c.products.where(flt.less_than("selling_price", "mrp")), "vendor_id")


def _f07(c: Catalog) -> DataFrame:
    return c.orders.where(flt.on_day("created_at", "1998-03-15")).select("id", "created_at")


def _f08(c: Catalog) -> DataFrame:
    kept = c.orders.where(flt.between_to_next_midnight("created_at", "2001-07-01", "2001-07-31"))
    return kept.agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_created"))


def _f09(c: Catalog) -> DataFrame:
    return _count(c.orders.where(flt.trailing("created_at", AS_OF, days=30)), "order_status")


def _f10(c: Catalog) -> DataFrame:
    wi = c.warehouse_inventory
    bands = {b: flt.expiry_band_stock("expiry_date", b, AS_OF) for b in ("expired", "expiring_soon", "good")}
    bands.update({b: flt.expiry_band_report("expiry_date", b, AS_OF) for b in ("expiring_7", "expiring_30")})
    return wi.agg(*[A.count_where(p).alias(b) for b, p in bands.items()])


def _f11(c: Catalog) -> DataFrame:
    cancelled = c.orders.where(F.col("order_status") == "cancelled").select(F.col("id").alias("order_id"))
    return _count(flt.in_keys(c.order_items, cancelled, "order_id"), "line_no")


def _f12(c: Catalog) -> DataFrame:
    cats = c.categories.select(F.col("id").alias("category_id"), F.col("parent_id").alias("__parent"))
    p = c.products.join(cats, "category_id", "left")
    return p.where(flt.category_or_parent("category_id", "__parent", 3)).select("id", "category_id")


def _f14(c: Catalog) -> DataFrame:
    s = c.salesmen
    return s.agg(A.count_where(flt.is_null("distributor_id")).alias("no_distributor"),
                 A.count_where(flt.not_null("distributor_id")).alias("with_distributor"))


def _f15(c: Catalog) -> DataFrame:
    return _count(c.orders.where(flt.in_values("order_status", ["placed", "confirmed"])), "order_status")


# Joins --------------------------------------------------------------------------------
def _j01(c: Catalog) -> DataFrame:
    lines = c.order_items.join(c.orders.select(F.col("id").alias("order_id"), "customer_id"), "order_id")
    named = lines.join(c.customers.select(F.col("id").alias("customer_id"), "occupation"), "customer_id")
    return named.groupBy("occupation").agg(F.count(F.lit(1)).alias("lines"),
                                            A.sum_or_zero("total").alias("amount"))


def _j02(c: Catalog) -> DataFrame:
    inv = c.inventory.select(F.col("product_id").alias("id"), "low_stock_threshold")
    j = c.products.select("id").join(inv, "id", "left")
    return j.agg(A.count_where(F.col("low_stock_threshold").isNull()).alias("without_inventory"),
                 F.count(F.lit(1)).alias("products"))


def _j06(c: Catalog) -> DataFrame:
    return J.primary_image(c.product_images)


def _j08(c: Catalog) -> DataFrame:
    pictured = c.product_images.select(F.col("product_id").alias("id"))
    return J.without(c.products.select("id", "name"), pictured, "id")


def _j09(c: Catalog) -> DataFrame:
    wished = c.wishlist.select(F.col("customer_id").alias("id"))
    return _count(J.having(c.customers, wished, "id"), "occupation")


# Aggregates ---------------------------------------------------------------------------
def _a01(c: Catalog) -> DataFrame:
    v = c.vendors
    return v.groupBy("state").agg(F.count(F.lit(1)).alias("vendors"),
                                  A.count_where(F.col("status") == "approved").alias("approved"))


def _a02(c: Catalog) -> DataFrame:
    paid = c.orders.where(F.col("payment_status") == "paid")
    per = paid.groupBy("customer_id").agg(A.sum_or_zero("final_amount").alias("spent"))
    j = c.customers.select(F.col("id").alias("customer_id")).join(per, "customer_id", "left")
    return j.select("customer_id", F.coalesce("spent", F.lit(0)).cast(A.MONEY).alias("spent"))


def _a03(c: Catalog) -> DataFrame:
    o = c.orders
    return o.groupBy(E.to_char("created_at", "YYYY-MM").alias("ym")).agg(
        A.sum_when("final_amount", F.col("payment_status") == "paid").alias("paid"),
        A.sum_or_zero("final_amount").alias("all_orders"))


def _a04(c: Catalog) -> DataFrame:
    return c.orders.groupBy("order_status").agg(A.distinct_count("customer_id").alias("customers"))


def _a07(c: Catalog) -> DataFrame:
    counted = A.count_children(c.orders.select("id"), c.order_items, "id", "order_id", "lines")
    return _count(counted, "lines")


def _a08(c: Catalog) -> DataFrame:
    rv = c.reviews.groupBy("product_id").agg(A.avg_or_zero("rating").alias("r"))
    j = c.products.select(F.col("id").alias("product_id")).join(rv, "product_id", "left")
    return j.select("product_id", F.coalesce("r", F.lit(0.0)).cast("decimal(18,6)").alias("avg_rating"))


def _a10(c: Catalog) -> DataFrame:
    s = c.supply_items
    return s.groupBy("product_id").agg(F.sum(F.col("quantity") * F.col("unit_price")).cast(A.MONEY).alias("value"))


def _a11(c: Catalog) -> DataFrame:
    return c.salesman_orders.select("salesman_id").distinct()


def _a12(c: Catalog) -> DataFrame:
    m = A.rows_to_map(c.user_permissions, "module", "granted", group=["user_id"], name="perms")
    granted = F.size(F.map_filter("perms", lambda k, v: v))
    return m.select("user_id", F.size("perms").cast("bigint").alias("modules"), granted.cast("bigint").alias("granted"))


# Ordering, top-k, pages ---------------------------------------------------------------------
def _l01(c: Catalog) -> DataFrame:
    return top_k(c.warehouse_inventory, [F.col("current_stock").desc(), F.col("warehouse_id"), F.col("product_id"),
                                         F.col("batch_number"), F.col("expiry_date").asc_nulls_last()], 7)


def _l03(c: Catalog) -> DataFrame:
    p, lim = clamp_page("0", "500", 100)  # page clamps to 1, limit to 100
    cnt = c.orders.agg(F.count(F.lit(1)).alias("total"))
    return page_meta(cnt, p, lim)


def _l05(c: Catalog) -> DataFrame:
    asc = top_k(c.cnf_orders, [pg_asc("warehouse_id"), F.col("id")], 5).select("id", "warehouse_id")
    desc = top_k(c.cnf_orders, [pg_desc("warehouse_id"), F.col("id")], 5).select("id", "warehouse_id")
    return asc.withColumn("dir", F.lit("asc")).unionByName(desc.withColumn("dir", F.lit("desc")))


# Scalar functions -----------------------------------------------------------------------------
def _e02(c: Catalog) -> DataFrame:
    o = c.orders.where(F.col("payment_status") == "paid")
    return _count(o.select(E.trunc_ts("created_at", "month").alias("month_start")), "month_start")


def _e03(c: Catalog) -> DataFrame:
    o = c.orders
    return o.select("id", E.day_of("created_at").alias("day"), E.next_day_midnight("created_at").alias("next_midnight"))


def _e05(c: Catalog) -> DataFrame:
    o = c.orders
    return o.agg(A.count_where(F.col("created_at") >= E.shifted(AS_OF, -90)).alias("last_90_days"))


def _e10(c: Catalog) -> DataFrame:
    return c.products.select("id", E.slug("name").alias("slug"))


def _e11(c: Catalog) -> DataFrame:
    first, rest = E.split_name("name")
    return c.products.select("id", first.alias("first_word"), rest.alias("rest"))


def _e12(c: Catalog) -> DataFrame:
    return c.products.select("id", F.upper(E.php_trim("name")).alias("upper_name"), F.lower("sku").alias("lower_sku"))


def _e14(c: Catalog) -> DataFrame:
    return c.orders.select("id", F.concat(F.lit("ORD-"), E.zero_pad("id", 8)).alias("order_ref"))


def _e15(c: Catalog) -> DataFrame:
    s = c.supply_items
    return s.groupBy("order_id").agg(
        E.money_round(F.sum(F.col("quantity") * F.col("unit_price") * (F.lit(1) + F.col("tax_rate") / 100)))
        .alias("with_tax"))


def _e16(c: Catalog) -> DataFrame:
    s = c.supply_items
    return s.groupBy("product_id").agg(F.ceil(F.avg("quantity")).cast("bigint").alias("ceil_avg"),
                                       F.greatest(F.max("quantity"), F.lit(10)).alias("at_least_10"),
                                       F.least(F.min("quantity"), F.lit(5)).alias("at_most_5"))


def _e17(c: Catalog) -> DataFrame:
    kinds = F.when(F.col("occupation") == "HOUSEHOLD", "home").when(F.col("occupation") == "BUILDING", "office") \
        .when(F.col("occupation") == "AUTOMOBILE", "farm").otherwise(F.col("occupation"))
    return _count(c.customers.select(E.address_type(kinds).alias("address_type")), "address_type")


def _e18(c: Catalog) -> DataFrame:
    e = c.base("events")
    tail = F.substring_index(F.col("props"), ":", -1)
    return e.select("event_id", E.php_int(tail).alias("k_int"), E.php_int(F.col("props")).alias("props_int"))


def sql(body: str, *names: str) -> str:
    return with_fixtures(body, *names)


REGISTRY = [
    Registered("f01_optional_predicates", _f01, sql(
        "SELECT payment_status, count(*) AS n FROM fx_orders WHERE order_status='delivered' GROUP BY 1", "fx_orders")),
    Registered("f02_equality", _f02, sql(
        "SELECT count(*) AS n, CAST(sum(stock_qty) AS BIGINT) AS stock FROM fx_products WHERE vendor_id = 3 AND is_active = TRUE",
        "fx_products")),
    Registered("f13_validity_interval", _f13, sql(
        """SELECT id, created_at FROM fx_banners WHERE CAST(created_at AS TIMESTAMP) <= TIMESTAMP '2024-03-01 06:00:00'
  AND CAST(created_at + 30 AS TIMESTAMP) >= TIMESTAMP '2024-03-01 06:00:00'""", "fx_banners")),
    Registered("f03_contains_ci", _f03, sql(
        "SELECT id, customer_code FROM fx_customers WHERE last_name ILIKE '%0_1%' OR customer_code ILIKE '%0_1%'",
        "fx_customers")),
    Registered("f05_price_range", _f05, sql(
        "SELECT id, selling_price FROM fx_products WHERE selling_price >= 950 AND selling_price <= 1000.5",
        "fx_products")),
    Registered("f06_column_compare", _f06, sql(
        "SELECT vendor_id, count(*) AS n FROM fx_products WHERE selling_price < mrp GROUP BY 1", "fx_products")),
    Registered("f07_calendar_day", _f07, sql(
        "SELECT id, created_at FROM fx_orders WHERE CAST(created_at AS DATE) = DATE '1998-03-15'", "fx_orders")),
    Registered("f08_range_to_next_midnight", _f08, sql(
        """SELECT count(*) AS n, max(created_at) AS last_created FROM fx_orders
WHERE created_at BETWEEN TIMESTAMP '2001-07-01 00:00:00' AND TIMESTAMP '2001-08-01 00:00:00'""", "fx_orders")),
    Registered("f09_trailing_interval", _f09, sql(
        f"SELECT order_status, count(*) AS n FROM fx_orders WHERE created_at >= {NOW} - INTERVAL 30 DAY GROUP BY 1",
        "fx_orders")),
    Registered("f10_expiry_bands", _f10, sql(
        f"""SELECT count(*) FILTER (WHERE CAST(expiry_date AS TIMESTAMP) < {NOW}) AS expired,
  count(*) FILTER (WHERE CAST(expiry_date AS TIMESTAMP) BETWEEN {NOW} AND {NOW} + INTERVAL 30 DAY) AS expiring_soon,
  count(*) FILTER (WHERE expiry_date IS NULL OR CAST(expiry_date AS TIMESTAMP) > {NOW} + INTERVAL 30 DAY) AS good,
  count(*) FILTER (WHERE CAST(expiry_date AS TIMESTAMP) BETWEEN {NOW} AND {NOW} + INTERVAL 7 DAY) AS expiring_7,
  count(*) FILTER (WHERE CAST(expiry_date AS TIMESTAMP) BETWEEN {NOW} AND {NOW} + INTERVAL 30 DAY) AS expiring_30
FROM fx_warehouse_inventory""", "fx_warehouse_inventory")),
    Registered("f11_key_list", _f11, sql(
        """SELECT line_no, count(*) AS n FROM fx_order_items WHERE order_id IN
  (SELECT id FROM fx_orders WHERE order_status='cancelled') GROUP BY 1""", "fx_order_items", "fx_orders")),
    Registered("f12_category_or_parent", _f12, sql(
        """SELECT p.id, p.category_id FROM fx_products p LEFT JOIN fx_categories c ON p.category_id=c.id
WHERE p.category_id=3 OR c.parent_id=3""", "fx_products", "fx_categories")),
    Registered("f14_null_tests", _f14, sql(
        """SELECT count(*) FILTER (WHERE distributor_id IS NULL) AS no_distributor,
  count(*) FILTER (WHERE distributor_id IS NOT NULL) AS with_distributor FROM fx_salesmen""", "fx_salesmen")),
    Registered("f15_enum_membership", _f15, sql(
        "SELECT order_status, count(*) AS n FROM fx_orders WHERE order_status IN ('placed','confirmed') GROUP BY 1",
        "fx_orders")),
    Registered("j01_inner_chain", _j01, sql(
        """SELECT c.occupation, count(*) AS lines, CAST(coalesce(sum(oi.total), 0) AS DECIMAL(38,2)) AS amount
FROM fx_order_items oi JOIN fx_orders o ON oi.order_id=o.id JOIN fx_customers c ON o.customer_id=c.id GROUP BY 1""",
        "fx_order_items", "fx_orders", "fx_customers")),
    Registered("j02_left_outer", _j02, sql(
        """SELECT count(*) FILTER (WHERE i.low_stock_threshold IS NULL) AS without_inventory, count(*) AS products
FROM fx_products p LEFT JOIN fx_inventory i ON i.product_id=p.id""", "fx_products", "fx_inventory")),
    Registered("j06_lateral_top1", _j06, sql(
        """SELECT product_id, image_url FROM (SELECT *, row_number() OVER (PARTITION BY product_id
  ORDER BY sort_order, id) AS rn FROM fx_product_images WHERE is_primary) WHERE rn=1""", "fx_product_images")),
    Registered("j08_anti_join", _j08, sql(
        "SELECT id, name FROM fx_products p WHERE NOT EXISTS (SELECT 1 FROM fx_product_images i WHERE i.product_id=p.id)",
        "fx_products", "fx_product_images")),
    Registered("j09_semi_join", _j09, sql(
        """SELECT occupation, count(*) AS n FROM fx_customers c
WHERE EXISTS (SELECT 1 FROM fx_wishlist w WHERE w.customer_id=c.id) GROUP BY 1""", "fx_customers", "fx_wishlist")),
    Registered("a01_filtered_counts", _a01, sql(
        "SELECT state, count(*) AS vendors, count(*) FILTER (WHERE status='approved') AS approved FROM fx_vendors GROUP BY 1",
        "fx_vendors")),
    Registered("a02_sum_or_zero", _a02, sql(
        """SELECT c.id AS customer_id, CAST(coalesce(sum(o.final_amount), 0) AS DECIMAL(38,2)) AS spent
FROM fx_customers c LEFT JOIN fx_orders o ON o.customer_id=c.id AND o.payment_status='paid' GROUP BY 1""",
        "fx_customers", "fx_orders")),
    Registered("a03_conditional_sum", _a03, sql(
        """SELECT strftime(created_at, '%Y-%m') AS ym,
  CAST(coalesce(sum(CASE WHEN payment_status='paid' THEN final_amount ELSE 0 END), 0) AS DECIMAL(38,2)) AS paid,
  CAST(coalesce(sum(final_amount), 0) AS DECIMAL(38,2)) AS all_orders FROM fx_orders GROUP BY 1""", "fx_orders")),
    Registered("a04_count_distinct", _a04, sql(
        "SELECT order_status, count(DISTINCT customer_id) AS customers FROM fx_orders GROUP BY 1", "fx_orders")),
    Registered("a07_count_children", _a07, sql(
        """SELECT lines, count(*) AS n FROM (SELECT o.id, count(oi.order_id) AS lines FROM fx_orders o
  LEFT JOIN fx_order_items oi ON oi.order_id=o.id GROUP BY o.id) GROUP BY 1""", "fx_orders", "fx_order_items")),
    Registered("a08_avg_or_zero", _a08, sql(
        """SELECT p.id AS product_id, CAST(CAST(coalesce(avg(r.rating), 0.0) AS DOUBLE) AS DECIMAL(18,6)) AS avg_rating
FROM fx_products p LEFT JOIN fx_reviews r ON r.product_id=p.id GROUP BY 1""", "fx_products", "fx_reviews")),
    Registered("a10_sum_of_products", _a10, sql(
        """SELECT product_id, CAST(sum(quantity * unit_price) AS DECIMAL(38,2)) AS value FROM fx_supply_items
GROUP BY 1""", "fx_supply_items")),
    Registered("a11_distinct_rows", _a11, sql("SELECT DISTINCT salesman_id FROM fx_salesman_orders",
                                              "fx_salesman_orders")),
    Registered("a12_rows_to_map", _a12, sql(
        """SELECT user_id, count(*) AS modules, count(*) FILTER (WHERE granted) AS granted
FROM fx_user_permissions GROUP BY 1""", "fx_user_permissions")),
    Registered("l01_top_k", _l01, sql(
        """SELECT * FROM fx_warehouse_inventory ORDER BY current_stock DESC, warehouse_id, product_id, batch_number,
  expiry_date NULLS LAST LIMIT 7""", "fx_warehouse_inventory")),
    Registered("l03_page_clamp_meta", _l03, sql(
        """SELECT count(*) AS total, 1 AS page, 100 AS "limit", CAST(ceil(count(*) / 100) AS BIGINT) AS pages
FROM fx_orders""", "fx_orders")),
    Registered("l05_postgres_null_order", _l05, sql(
        """(SELECT id, warehouse_id, 'asc' AS dir FROM fx_cnf_orders ORDER BY warehouse_id ASC NULLS LAST, id LIMIT 5)
UNION ALL (SELECT id, warehouse_id, 'desc' FROM fx_cnf_orders ORDER BY warehouse_id DESC NULLS FIRST, id LIMIT 5)""",
        "fx_cnf_orders")),
    Registered("e02_date_trunc", _e02, sql(
        """SELECT date_trunc('month', created_at) AS month_start, count(*) AS n FROM fx_orders
WHERE payment_status='paid' GROUP BY 1""", "fx_orders")),
    Registered("e03_date_and_next_day", _e03, sql(
        """SELECT id, CAST(created_at AS DATE) AS day, CAST(CAST(created_at AS DATE) + 1 AS TIMESTAMP) AS next_midnight
FROM fx_orders""", "fx_orders")),
    Registered("e05_interval_arithmetic", _e05, sql(
        f"SELECT count(*) FILTER (WHERE created_at >= {NOW} - INTERVAL 90 DAY) AS last_90_days FROM fx_orders",
        "fx_orders")),
    Registered("e10_slug", _e10, sql(
        "SELECT id, lower(regexp_replace(name, '[^a-z0-9]+', '-', 'g')) AS slug FROM fx_products", "fx_products")),
    Registered("e11_split_name", _e11, sql(
        """SELECT id, split_part(trim(name), ' ', 1) AS first_word,
  CASE WHEN strpos(trim(name), ' ') > 0 THEN substr(trim(name), strpos(trim(name), ' ') + 1) ELSE '' END AS rest
FROM fx_products""", "fx_products")),
    Registered("e12_trim_case", _e12, sql(
        "SELECT id, upper(trim(name)) AS upper_name, lower(sku) AS lower_sku FROM fx_products", "fx_products")),
    Registered("e14_zero_pad", _e14, sql(
        "SELECT id, 'ORD-' || lpad(CAST(id AS VARCHAR), 8, '0') AS order_ref FROM fx_orders", "fx_orders")),
    Registered("e15_money_round", _e15, sql(
        """SELECT order_id, CAST(round(CAST(sum(quantity * unit_price * (1 + tax_rate / 100)) AS DECIMAL(38,6)), 2)
  AS DECIMAL(38,2)) AS with_tax FROM fx_supply_items GROUP BY 1""", "fx_supply_items")),
    Registered("e16_ceil_least_greatest", _e16, sql(
        """SELECT product_id, CAST(ceil(avg(quantity)) AS BIGINT) AS ceil_avg, greatest(max(quantity), 10) AS at_least_10,
  least(min(quantity), 5) AS at_most_5 FROM fx_supply_items GROUP BY 1""", "fx_supply_items")),
    Registered("e17_address_type", _e17, sql(
        """SELECT CASE WHEN k IN ('office','farm','work') THEN 'work' WHEN k='home' THEN 'home' ELSE 'other' END
  AS address_type, count(*) AS n FROM (SELECT lower(CASE occupation WHEN 'HOUSEHOLD' THEN 'home'
  WHEN 'BUILDING' THEN 'office' WHEN 'AUTOMOBILE' THEN 'farm' ELSE occupation END) AS k FROM fx_customers) GROUP BY 1""",
        "fx_customers")),
    Registered("e18_lenient_int", _e18, """SELECT event_id,
  coalesce(TRY_CAST(regexp_extract(ltrim(split_part(props, ':', -1)), '^[+-]?[0-9]+', 0) AS BIGINT), 0) AS k_int,
  coalesce(TRY_CAST(regexp_extract(ltrim(props), '^[+-]?[0-9]+', 0) AS BIGINT), 0) AS props_int FROM events"""),
]
