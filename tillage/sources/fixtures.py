"""Stand-in inputs: the marketplace tables derived from the driver's test tables.

Each builder only renames and retypes driver columns into the schema the
reports expect (see FIXTURES.md); none of them does any report's work. The
SQL text of each view is kept next to it because the DuckDB oracle builds the
same inputs from the same tables.

:class:`Catalog` hands out the views lazily; nothing is read until an action.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.sources.tables import read_table



def _day0(iso: str):
    return F.lit(iso).cast("date")


def _suffix(name_col: str):
    return F.split_part(F.col(name_col), F.lit("#"), F.lit(2))


class Catalog:
    """Lazy access to driver tables and the marketplace views built from them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self._base: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._base:
            self._base[name] = read_table(self.spark, self.root, name)
        return self._base[name]

    # -- people -----------------------------------------------------------
    @cached_property
    def customers(self) -> DataFrame:
        c = self.base("customer")
        return c.select(
            F.col("c_custkey").alias("id"),
            F.col("c_custkey").alias("user_id"),
            F.lit("Customer").alias("first_name"),
            _suffix("c_name").alias("last_name"),
            F.concat(F.lit("CUS-"), _suffix("c_name")).alias("customer_code"),
            F.col("c_mktsegment").alias("occupation"),
            (F.col("c_custkey") % 7 != 0).alias("is_active"),
            F.date_add(_day0("1995-01-01"), (F.col("c_custkey") % 2000).cast("int")).alias("created_at"),
        )

    @cached_property
    def users(self) -> DataFrame:
        c = self.base("customer")
        role = (F.when(F.col("c_custkey") % 10 == 0, "admin")
                .when(F.col("c_custkey") % 10 == 1, "owner")
                .when(F.col("c_custkey") % 10 == 2, "superadmin")
                .otherwise("customer"))
        return c.select(
            F.col("c_custkey").alias("id"),
            F.lit("User").alias("first_name"),
            _suffix("c_name").alias("last_name"),
            role.alias("role"),
            (F.col("c_custkey") % 7 != 0).alias("is_active"),
            F.date_add(_day0("1995-01-01"), (F.col("c_custkey") % 2000).cast("int")).alias("created_at"),
        )

    @cached_property
    def addresses(self) -> DataFrame:
        c = self.base("customer").select("c_custkey", "c_nationkey")
        n = self.base("nation")
        r = self.base("region")
        return (c.join(n, c.c_nationkey == n.n_nationkey)
                .join(r, n.n_regionkey == r.r_regionkey)
                .select(F.col("c_custkey").alias("id"),
                        F.col("c_custkey").alias("customer_id"),
                        F.col("n_name").alias("city"),
                        F.col("r_name").alias("state"),
                        (F.col("c_custkey") % 3 != 0).alias("is_default")))

    @cached_property
    def vendors(self) -> DataFrame:
        s = self.base("supplier").select("s_suppkey", "s_name", "s_nationkey")
        n = self.base("nation")
        r = self.base("region")
        status = (F.when(F.col("s_suppkey") % 5 == 0, "pending")
                  .when(F.col("s_suppkey") % 5 == 1, "rejected")
                  .otherwise("approved"))
        return (s.join(n, s.s_nationkey == n.n_nationkey)
                .join(r, n.n_regionkey == r.r_regionkey)
                .select(F.col("s_suppkey").alias("id"),
                        F.col("s_name").alias("business_name"),
                        status.alias("status"),
                        F.col("n_name").alias("city"),
                        F.col("r_name").alias("state"),
                        F.date_add(_day0("1995-01-01"), F.col("s_suppkey").cast("int")).alias("created_at")))

    @cached_property
    def salesmen(self) -> DataFrame:
        s = self.base("supplier")
        dist = F.when(F.col("s_suppkey") % 4 == 0, F.lit(None).cast("bigint")) \
            .otherwise((F.col("s_suppkey") + 1) % 10)
        return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                        dist.alias("distributor_id"))

    @cached_property
    def manufacturers(self) -> DataFrame:
        s = self.base("supplier")
        return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                        (F.col("s_suppkey") % 4 != 0).alias("is_active"))

    # -- catalogue --------------------------------------------------------
    @cached_property
    def categories(self) -> DataFrame:
        r = self.base("region").select(
            F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"),
            F.lit(None).cast("int").alias("parent_id"), F.col("r_regionkey").alias("sort_order"))
        n = self.base("nation").select(
            (F.lit(100) + F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"),
            F.col("n_regionkey").alias("parent_id"), F.col("n_nationkey").alias("sort_order"))
        return r.unionByName(n)

    @cached_property
    def products(self) -> DataFrame:
        p = self.base("part")
        mrp = F.col("p_retailprice").cast("decimal(10,2)")
        selling = (mrp * (F.lit(100) - F.col("p_size") % 10) / F.lit(100)).cast("decimal(10,2)")
        return p.select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("sku"),
            (F.col("p_partkey") % 10).alias("vendor_id"),
            (F.lit(100) + F.col("p_partkey") % 25).cast("int").alias("category_id"),
            mrp.alias("mrp"),
            selling.alias("selling_price"),
            F.col("p_size").alias("stock_qty"),
            (F.col("p_partkey") % 10 != 0).alias("is_active"),
            F.col("p_type").alias("unit"),
        )

    @cached_property
    def brands(self) -> DataFrame:
        p = self.base("part")
        return (p.groupBy("p_brand")
                .agg(F.min("p_partkey").alias("id"))
                .select("id", F.col("p_brand").alias("name"),
                        F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("-"))).alias("slug"),
                        (F.col("id") % 5 != 0).alias("is_active")))

    @cached_property
    def product_images(self) -> DataFrame:
        pg = self.base("pages").select("page_id", "url")
        return pg.select(F.col("page_id").alias("id"), (F.col("page_id") % 40).alias("product_id"),
                         F.col("url").alias("image_url"), F.col("page_id").cast("int").alias("sort_order"),
                         (F.col("page_id") % 2 == 0).alias("is_primary"))

    @cached_property
    def inventory(self) -> DataFrame:
        p = self.base("part")
        return (p.where(F.col("p_partkey") % 4 != 0)
                .select(F.col("p_partkey").alias("product_id"), F.col("p_size").alias("current_stock"),
                        (F.lit(5) + F.col("p_partkey") % 10).cast("int").alias("low_stock_threshold")))

    # -- orders -----------------------------------------------------------
    @cached_property
    def orders(self) -> DataFrame:
        # address_id: the address stand-in is keyed by the customer key, so an
        # order's delivery address is its customer's address row.
        o = self.base("orders")
        pay = (F.when(F.col("o_orderstatus") == "F", "paid")
               .when(F.col("o_orderstatus") == "O", "pending").otherwise("failed"))
        prio = F.substring(F.col("o_orderpriority"), 1, 1)
        status = (F.when(prio == "1", "placed").when(prio == "2", "confirmed")
                  .when(prio == "3", "shipped").when(prio == "4", "delivered")
                  .otherwise("cancelled"))
        return o.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_custkey").alias("address_id"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("final_amount"),
            pay.alias("payment_status"),
            status.alias("order_status"),
            F.col("o_orderdate").alias("created_at"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        li = self.base("lineitem")
        return li.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("total"),
        )

    @cached_property
    def salesman_orders(self) -> DataFrame:
        li = self.base("lineitem")
        return li.select(F.col("l_orderkey").alias("order_id"),
                         F.col("l_suppkey").alias("salesman_id")).distinct()

    @cached_property
    def payments(self) -> DataFrame:
        o = self.orders
        method = (F.when(F.col("id") % 3 == 0, "cod").when(F.col("id") % 3 == 1, "upi")
                  .otherwise("card"))
        return o.select(F.col("id").alias("order_id"), method.alias("payment_method"),
                        F.col("final_amount").alias("amount"), "payment_status")

    @cached_property
    def status_events(self) -> DataFrame:
        e = self.base("events")
        et = F.col("event_type")
        status = (F.when(et == "signup", "confirmed").when(et == "view", "packed")
                  .when(et == "click", "shipped").when(et == "purchase", "delivered")
                  .otherwise("cancelled"))
        return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("order_id"),
                        status.alias("status"), F.col("ts").alias("created_at"))

    @cached_property
    def stock_movements(self) -> DataFrame:
        oi = self.order_items
        o = self.orders
        ordered = oi.select("product_id", F.lit("order").alias("kind"),
                            (-F.col("quantity")).alias("delta"))
        cancelled = (oi.join(o.where(F.col("order_status") == "cancelled"),
                             oi.order_id == o.id)
                     .select(oi.product_id, F.lit("cancel").alias("kind"),
                             F.col("quantity").alias("delta")))
        restock = (self.base("events").where(F.col("event_type") == "purchase")
                   .select((F.col("event_id") % 200).alias("product_id"),
                           F.lit("restock").alias("kind"), F.lit(10).alias("delta")))
        return ordered.unionByName(cancelled).unionByName(restock)

    # -- customer activity (events) ---------------------------------------
    @cached_property
    def reviews(self) -> DataFrame:
        e = self.base("events").where(F.col("event_type") == "view")
        return e.select(F.col("event_id").alias("id"), (F.col("event_id") % 200).alias("product_id"),
                        F.col("user_id").alias("customer_id"),
                        (F.lit(1) + F.col("event_id") % 5).cast("int").alias("rating"),
                        (F.col("event_id") % 11 != 0).alias("is_approved"),
                        F.col("ts").alias("created_at"))

    @cached_property
    def wishlist(self) -> DataFrame:
        e = self.base("events").where(F.col("event_type") == "signup")
        return (e.groupBy(F.col("user_id").alias("customer_id"),
                          (F.col("event_id") % 200).alias("product_id"))
                .agg(F.min("ts").alias("created_at")))

    @cached_property
    def cart(self) -> DataFrame:
        e = self.base("events").where(F.col("event_type") == "click")
        return (e.groupBy(F.col("user_id").alias("customer_id"),
                          (F.col("event_id") % 200).alias("product_id"))
                .agg((F.lit(1) + F.max("event_id") % 5).cast("int").alias("quantity")))

    @cached_property
    def permission_changes(self) -> DataFrame:
        e = self.base("events")
        return e.select(F.col("event_id").alias("id"), ((F.col("user_id") * 7) % 15).alias("changed_by"),
                        F.col("user_id").alias("target_user"), F.col("event_type").alias("module"),
                        (F.col("event_id") % 3 != 0).alias("new_value"), F.col("ts").alias("created_at"))

    @cached_property
    def user_permissions(self) -> DataFrame:
        e = self.base("events")
        return (e.groupBy("user_id", F.col("event_type").alias("module"))
                .agg((F.max("event_id") % 3 != 0).alias("granted")))

    # -- vendors, banners ---------------------------------------------------
    @cached_property
    def vendor_documents(self) -> DataFrame:
        pg = self.base("pages").select("page_id", "url")
        dt = (F.when(F.col("page_id") % 3 == 0, "PAN").when(F.col("page_id") % 3 == 1, "AADHAAR")
              .otherwise("OTHER"))
        return pg.select(F.col("page_id").alias("id"), (F.col("page_id") % 10).alias("vendor_id"),
                         dt.alias("document_type"), F.col("url").alias("document_url"))

    @cached_property
    def banners(self) -> DataFrame:
        pg = self.base("pages").select("page_id", "url")
        return pg.select(F.col("page_id").alias("id"), F.col("url").alias("image_url"),
                         (F.col("page_id") % 4 != 0).alias("is_active"),
                         F.date_add(_day0("2024-01-01"), F.col("page_id").cast("int")).alias("created_at"))

    # -- depots (C&F) -------------------------------------------------------
    @cached_property
    def cnf_companies(self) -> DataFrame:
        r = self.base("region")
        return r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"),
                        F.col("r_name").alias("state"))

    @cached_property
    def warehouses(self) -> DataFrame:
        n = self.base("nation")
        return n.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("cnf_company_id"),
                        F.col("n_name").alias("name"))

    @cached_property
    def warehouse_inventory(self) -> DataFrame:
        li = self.base("lineitem").select("l_suppkey", "l_partkey", "l_linenumber", "l_returnflag",
                                          "l_shipdate", "l_quantity")
        s = self.base("supplier").select("s_suppkey", "s_nationkey")
        expiry = F.when(F.col("l_returnflag") == "R", F.lit(None).cast("date")) \
            .otherwise(F.col("l_shipdate").cast("date"))
        return (li.join(s, li.l_suppkey == s.s_suppkey)
                .select(F.col("s_nationkey").alias("warehouse_id"), F.col("l_partkey").alias("product_id"),
                        F.col("l_linenumber").alias("batch_number"), expiry.alias("expiry_date"),
                        F.col("l_quantity").cast("int").alias("current_stock")))

    @cached_property
    def cnf_orders(self) -> DataFrame:
        o = self.base("orders")
        wh = F.when(F.col("o_orderkey") % 6 == 0, F.lit(None).cast("int")) \
            .otherwise((F.col("o_orderkey") % 25).cast("int"))
        st = (F.when(F.col("o_orderstatus") == "F", "delivered")
              .when(F.col("o_orderstatus") == "O", "pending").otherwise("dispatched"))
        return o.select(F.col("o_orderkey").alias("id"),
                        F.concat(F.lit("CNF-INV-"), F.col("o_orderkey").cast("string")).alias("invoice_number"),
                        (F.col("o_orderkey") % 5).cast("int").alias("cnf_company_id"),
                        wh.alias("warehouse_id"), F.col("o_orderdate").alias("order_date"),
                        F.col("o_totalprice").cast("decimal(12,2)").alias("total_amount"),
                        st.alias("order_status"))

    @cached_property
    def manufacturer_orders(self) -> DataFrame:
        o = self.base("orders")
        st = (F.when(F.col("o_orderstatus") == "F", "delivered")
              .when(F.col("o_orderstatus") == "O", "pending").otherwise("dispatched"))
        return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("manufacturer_id"),
                        F.concat(F.lit("MFR-"), F.col("o_orderkey").cast("string")).alias("order_number"),
                        F.col("o_orderdate").alias("order_date"),
                        F.col("o_totalprice").cast("decimal(12,2)").alias("total_amount"),
                        st.alias("status"))

    @cached_property
    def supply_items(self) -> DataFrame:
        li = self.base("lineitem")
        return li.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
                         F.col("l_quantity").cast("int").alias("quantity"),
                         (F.lit(900) + F.col("l_partkey") % 100).cast("decimal(10,2)").alias("unit_price"),
                         F.col("l_tax").cast("decimal(5,2)").alias("tax_rate"),
                         F.col("l_discount").cast("decimal(10,2)").alias("discount"))

    @cached_property
    def coupons(self) -> DataFrame:
        from tillage.sources.literals import seed_coupons
        return seed_coupons(self.spark)


# SQL text of the same views, for the DuckDB oracle (driver tables are views there).
FIXTURE_SQL = {
    "fx_customers": "SELECT c_custkey AS id, c_custkey AS user_id, 'Customer' AS first_name, split_part(c_name,'#',2) AS last_name, concat('CUS-',split_part(c_name,'#',2)) AS customer_code, c_mktsegment AS occupation, c_custkey % 7 <> 0 AS is_active, CAST('1995-01-01' AS DATE) + CAST(c_custkey % 2000 AS INT) AS created_at FROM customer",
    "fx_addresses": "SELECT c_custkey AS id, c_custkey AS customer_id, n_name AS city, r_name AS state, c_custkey % 3 <> 0 AS is_default FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey",
    "fx_vendors": "SELECT s_suppkey AS id, s_name AS business_name, CASE s_suppkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'rejected' ELSE 'approved' END AS status, n_name AS city, r_name AS state, CAST('1995-01-01' AS DATE) + CAST(s_suppkey AS INT) AS created_at FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey",
    "fx_categories": "SELECT r_regionkey AS id, r_name AS name, CAST(NULL AS INT) AS parent_id, r_regionkey AS sort_order FROM region UNION ALL SELECT 100+n_nationkey, n_name, n_regionkey, n_nationkey FROM nation",
    "fx_products": "SELECT p_partkey AS id, p_name AS name, p_brand AS sku, p_partkey % 10 AS vendor_id, CAST(100 + p_partkey % 25 AS INT) AS category_id, CAST(p_retailprice AS DECIMAL(10,2)) AS mrp, CAST(CAST(p_retailprice AS DECIMAL(10,2)) * (100 - p_size % 10) / 100 AS DECIMAL(10,2)) AS selling_price, p_size AS stock_qty, p_partkey % 10 <> 0 AS is_active, p_type AS unit FROM part",
    "fx_orders": "SELECT o_orderkey AS id, o_custkey AS customer_id, o_custkey AS address_id, CAST(o_totalprice AS DECIMAL(12,2)) AS final_amount, CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'failed' END AS payment_status, CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'placed' WHEN '2' THEN 'confirmed' WHEN '3' THEN 'shipped' WHEN '4' THEN 'delivered' ELSE 'cancelled' END AS order_status, o_orderdate AS created_at FROM orders",
    "fx_order_items": "SELECT l_orderkey AS order_id, l_partkey AS product_id, l_linenumber AS line_no, CAST(l_quantity AS INT) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS total FROM lineitem",
    "fx_salesmen": "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (s_suppkey + 1) % 10 END AS distributor_id FROM supplier",
    "fx_salesman_orders": "SELECT DISTINCT l_orderkey AS order_id, l_suppkey AS salesman_id FROM lineitem",
    "fx_cnf_companies": "SELECT r_regionkey AS id, r_name AS name, r_name AS state FROM region",
    "fx_warehouses": "SELECT n_nationkey AS id, n_regionkey AS cnf_company_id, n_name AS name FROM nation",
    "fx_warehouse_inventory": "SELECT s_nationkey AS warehouse_id, l_partkey AS product_id, l_linenumber AS batch_number, CASE WHEN l_returnflag='R' THEN NULL ELSE CAST(l_shipdate AS DATE) END AS expiry_date, CAST(l_quantity AS INT) AS current_stock FROM lineitem JOIN supplier ON l_suppkey=s_suppkey",
    "fx_reviews": "SELECT event_id AS id, event_id % 200 AS product_id, user_id AS customer_id, CAST(1 + event_id % 5 AS INT) AS rating, event_id % 11 <> 0 AS is_approved, ts AS created_at FROM events WHERE event_type='view'",
    "fx_wishlist": "SELECT user_id AS customer_id, event_id % 200 AS product_id, min(ts) AS created_at FROM events WHERE event_type='signup' GROUP BY user_id, event_id % 200",
    "fx_cart": "SELECT user_id AS customer_id, event_id % 200 AS product_id, CAST(1 + max(event_id) % 5 AS INT) AS quantity FROM events WHERE event_type='click' GROUP BY user_id, event_id % 200",
    "fx_product_images": "SELECT page_id AS id, page_id % 40 AS product_id, url AS image_url, CAST(page_id AS INT) AS sort_order, page_id % 2 = 0 AS is_primary FROM pages",
    "fx_payments": "SELECT id AS order_id, CASE id % 3 WHEN 0 THEN 'cod' WHEN 1 THEN 'upi' ELSE 'card' END AS payment_method, final_amount AS amount, payment_status FROM fx_orders",
    "fx_status_events": "SELECT event_id AS id, user_id AS order_id, CASE event_type WHEN 'signup' THEN 'confirmed' WHEN 'view' THEN 'packed' WHEN 'click' THEN 'shipped' WHEN 'purchase' THEN 'delivered' ELSE 'cancelled' END AS status, ts AS created_at FROM events",
    "fx_permission_changes": "SELECT event_id AS id, (user_id*7) % 15 AS changed_by, user_id AS target_user, event_type AS module, event_id % 3 <> 0 AS new_value, ts AS created_at FROM events",
    "fx_vendor_documents": "SELECT page_id AS id, page_id % 10 AS vendor_id, CASE page_id % 3 WHEN 0 THEN 'PAN' WHEN 1 THEN 'AADHAAR' ELSE 'OTHER' END AS document_type, url AS document_url FROM pages",
    "fx_coupons": "SELECT code, discount_type, CAST(discount_value AS DECIMAL(10,2)) AS discount_value, CAST(minimum_order_amount AS DECIMAL(10,2)) AS minimum_order_amount, CAST(NULL AS DECIMAL(10,2)) AS max_discount, TRUE AS is_active, TIMESTAMP '2001-07-15 00:00:00' AS valid_from, TIMESTAMP '2001-07-15 00:00:00' + to_days(days) AS valid_to FROM (VALUES ('AGRO10','percentage',10.00,299.00,30),('FIRST50','flat',50.00,199.00,60)) AS t(code,discount_type,discount_value,minimum_order_amount,days)",
    "fx_users": "SELECT c_custkey AS id, 'User' AS first_name, split_part(c_name,'#',2) AS last_name, CASE c_custkey % 10 WHEN 0 THEN 'admin' WHEN 1 THEN 'owner' WHEN 2 THEN 'superadmin' ELSE 'customer' END AS role, c_custkey % 7 <> 0 AS is_active, CAST('1995-01-01' AS DATE) + CAST(c_custkey % 2000 AS INT) AS created_at FROM customer",
    "fx_user_permissions": "SELECT user_id, event_type AS module, max(event_id) % 3 <> 0 AS granted FROM events GROUP BY user_id, event_type",
    "fx_brands": "SELECT min(p_partkey) AS id, p_brand AS name, lower(replace(p_brand,'#','-')) AS slug, min(p_partkey) % 5 <> 0 AS is_active FROM part GROUP BY p_brand",
    "fx_banners": "SELECT page_id AS id, url AS image_url, page_id % 4 <> 0 AS is_active, CAST('2024-01-01' AS DATE) + CAST(page_id AS INT) AS created_at FROM pages",
    "fx_inventory": "SELECT p_partkey AS product_id, p_size AS current_stock, CAST(5 + p_partkey % 10 AS INT) AS low_stock_threshold FROM part WHERE p_partkey % 4 <> 0",
    "fx_manufacturers": "SELECT s_suppkey AS id, s_name AS name, s_suppkey % 4 <> 0 AS is_active FROM supplier",
    "fx_manufacturer_orders": "SELECT o_orderkey AS id, o_custkey % 10 AS manufacturer_id, concat('MFR-', o_orderkey) AS order_number, o_orderdate AS order_date, CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount, CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'pending' ELSE 'dispatched' END AS status FROM orders",
    "fx_cnf_orders": "SELECT o_orderkey AS id, concat('CNF-INV-', o_orderkey) AS invoice_number, CAST(o_orderkey % 5 AS INT) AS cnf_company_id, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 25 AS INT) END AS warehouse_id, o_orderdate AS order_date, CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount, CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'pending' ELSE 'dispatched' END AS order_status FROM orders",
    "fx_supply_items": "SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS INT) AS quantity, CAST(900 + l_partkey % 100 AS DECIMAL(10,2)) AS unit_price, CAST(l_tax AS DECIMAL(5,2)) AS tax_rate, CAST(l_discount AS DECIMAL(10,2)) AS discount FROM lineitem",
    "fx_stock_movements": "SELECT product_id, 'order' AS kind, -quantity AS delta FROM fx_order_items UNION ALL SELECT i.product_id, 'cancel', i.quantity FROM fx_order_items i JOIN fx_orders o ON i.order_id=o.id WHERE o.order_status='cancelled' UNION ALL SELECT event_id % 200, 'restock', 10 FROM events WHERE event_type='purchase'",
}

# Views a view's SQL refers to (so the oracle emits them first).
FIXTURE_DEPS = {
    "fx_payments": ["fx_orders"],
    "fx_stock_movements": ["fx_order_items", "fx_orders"],
}


def with_fixtures(body: str, *names: str) -> str:
    """Prefix ``body`` with ``WITH`` clauses for the named fixture views (and their deps)."""
    ordered: list[str] = []

    def add(n: str) -> None:
        for d in FIXTURE_DEPS.get(n, []):
            add(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n]})" for n in ordered)
    if not ordered:
        return body
    head = body.lstrip()
    if head[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{head[5:]}"
    return f"WITH {ctes}\n{body}"
