"""Declared schemas of the marketplace tables, and files of several versions brought to one schema.

``supply_items`` is the shared shape of the two invoice-line tables
(``manufacturer_order_items``, ``cnf_order_items``) as the reports read them;
both full tables are declared too. Types follow the DDL of all migrations
(UUID -> a long key, which widens to string where files hold text; DECIMAL(p,s) ->
decimal; TIMESTAMP -> timestamp_ntz). The search vector is built by a
query, so it isn't stored; credentials (:data:`WITHHELD`) are never carried.

:func:`reconciled` takes inputs of older and newer column sets and returns one
table: every declared column (the DDL's default, else NULL, where an input
lacks it), types widened where an input holds more than the declared one can,
unknown columns kept after them, and, if asked, the names of the columns whose
value didn't cast, row by row. Inputs only project and union, so
filters and pruned columns still reach each scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WITHHELD = frozenset({"password_hash", "otp_code", "razorpay_signature"})

# Table and column names and types of the marketplace schema.
DDL = {
    "users": "id bigint, first_name string, last_name string, email string, mobile string, role string, is_active "
             "boolean, gender string, occupation string, created_at date, farm_size string, primary_crop string, dob "
             "date, updated_at timestamp_ntz",
    "customers": "id bigint, user_id bigint, customer_code string, occupation string, is_active boolean, created_at "
                 "date, total_orders int, total_spent decimal(15,2), loyalty_points int",
    "customer_addresses": "id bigint, customer_id bigint, full_name string, mobile string, city string, state string, "
                          "pincode string, address_type string, is_default boolean, address_line1 string, "
                          "address_line2 string, district string, country string, created_at timestamp_ntz",
    "vendors": "id bigint, user_id bigint, vendor_code string, business_name string, owner_name string, status "
               "string, city string, state string, is_verified boolean, created_at date, email string, mobile string, "
               "gst_number string, pan_number string, address string, pincode string, vendor_type string, "
               "licence_number string, updated_at timestamp_ntz",
    "vendor_documents": "id bigint, vendor_id bigint, document_type string, document_url string, is_verified boolean, "
                        "uploaded_at timestamp_ntz",
    "categories": "id int, name string, parent_id int, sort_order int, is_active boolean, slug string, description "
                  "string, icon string, image_url string, is_featured boolean, created_at timestamp_ntz",
    "brands": "id bigint, name string, slug string, logo_url string, description string, is_active boolean, "
              "created_at timestamp_ntz",
    "products": "id bigint, vendor_id bigint, category_id int, brand_id bigint, name string, description string, sku "
                "string, product_code string, mrp decimal(10,2), selling_price decimal(10,2), stock_qty int, "
                "sold_count bigint, unit string, is_active boolean, slug string, hsn_code string, gst_rate "
                "decimal(5,2), avg_rating decimal(3,2), review_count int, is_featured boolean, weight decimal(8,2), "
                "created_at timestamp_ntz, updated_at timestamp_ntz",
    "inventory": "product_id bigint, current_stock int, low_stock_threshold int, id bigint, updated_at timestamp_ntz",
    "product_images": "id bigint, product_id bigint, image_url string, sort_order int, is_primary boolean, alt_text "
                      "string, created_at timestamp_ntz",
    "cart": "customer_id bigint, product_id bigint, quantity int, id bigint, created_at timestamp_ntz",
    "wishlist": "customer_id bigint, product_id bigint, created_at timestamp_ntz, id bigint",
    "orders": "id bigint, customer_id bigint, address_id bigint, order_number string, final_amount decimal(12,2), "
              "payment_status string, order_status string, created_at timestamp_ntz, total_amount decimal(12,2), "
              "discount_amount decimal(12,2), shipping_charge decimal(10,2), placed_at timestamp_ntz, updated_at "
              "timestamp_ntz",
    "order_items": "order_id bigint, product_id bigint, line_no int, quantity int, total decimal(12,2), product_name "
                   "string, id bigint, vendor_id bigint, price decimal(10,2), unit_price decimal(10,2), product_image "
                   "string",
    "order_status_history": "id bigint, order_id bigint, status string, created_at timestamp_ntz, remarks string",
    "payments": "order_id bigint, payment_method string, amount decimal(12,2), payment_status string, id bigint, "
                "razorpay_order_id string, razorpay_payment_id string, paid_at timestamp_ntz, created_at "
                "timestamp_ntz",
    "coupons": "code string, discount_type string, discount_value decimal(10,2), minimum_order_amount decimal(10,2), "
               "max_discount decimal(10,2), is_active boolean, valid_from timestamp_ntz, valid_to timestamp_ntz, id "
               "bigint, title string, usage_limit int, used_count int, created_at timestamp_ntz",
    "reviews": "id bigint, product_id bigint, customer_id bigint, rating int, is_approved boolean, created_at "
               "timestamp_ntz, review_text string",
    "banners": "id bigint, title string, image_url string, is_active boolean, created_at date, link_url string, "
               "sort_order int, start_date date, end_date date",
    "user_permissions": "user_id bigint, module string, granted boolean, id bigint, granted_by bigint, created_at "
                        "timestamp_ntz, updated_at timestamp_ntz",
    "permission_audit": "id bigint, changed_by bigint, target_user bigint, module string, new_value boolean, "
                        "created_at timestamp_ntz, old_value boolean",
    "manufacturers": "id bigint, name string, mobile string, is_active boolean, contact_name string, email string, "
                     "address string, city string, state string, pincode string, gst_number string, created_at "
                     "timestamp_ntz",
    "manufacturer_orders": "id bigint, manufacturer_id bigint, order_number string, order_date timestamp_ntz, "
                           "total_amount decimal(12,2), status string, order_id bigint, invoice_number string, notes "
                           "string, created_at timestamp_ntz, updated_at timestamp_ntz",
    "supply_items": "order_id bigint, product_id bigint, quantity int, unit_price decimal(10,2), tax_rate "
                    "decimal(5,2), discount decimal(10,2)",
    "cnf_companies": "id int, name string, contact_person string, state string, contact_number string, email string, "
                     "address string, city string, pincode string, gst_number string, status string, created_at "
                     "timestamp_ntz, updated_at timestamp_ntz",
    "warehouses": "id int, cnf_company_id int, name string, state string, address string, city string, pincode "
                  "string, manager_name string, contact_number string, email string, status string, created_at "
                  "timestamp_ntz, updated_at timestamp_ntz",
    "warehouse_inventory": "warehouse_id int, product_id bigint, batch_number string, expiry_date date, current_stock "
                           "int, id bigint, reserved_stock int, incoming_stock int, outgoing_stock int, "
                           "last_movement_at timestamp_ntz, updated_at timestamp_ntz",
    "cnf_orders": "id bigint, invoice_number string, cnf_company_id int, warehouse_id int, order_date timestamp_ntz, "
                  "total_amount decimal(12,2), order_status string, payment_status string, notes string, created_at "
                  "timestamp_ntz, updated_at timestamp_ntz",
    "salesmen": "id bigint, name string, mobile string, distributor_id bigint, user_id bigint, email string, "
                "is_active boolean, created_at timestamp_ntz",
    "salesman_orders": "order_id bigint, salesman_id bigint, id bigint, created_at timestamp_ntz",
    "manufacturer_order_items": "manufacturer_order_id bigint, product_id bigint, product_name string, quantity int, "
                                "unit_price decimal(10,2), tax_rate decimal(5,2), discount decimal(10,2), total "
                                "decimal(12,2), id bigint",
    "cnf_order_items": "cnf_order_id bigint, product_id bigint, product_name string, quantity int, unit_price "
                       "decimal(10,2), total decimal(12,2), id bigint",
    "coupon_usage": "coupon_code string, customer_id bigint, order_id bigint, used_at timestamp_ntz, id bigint, "
                    "coupon_id bigint",
    "notifications": "id bigint, user_id bigint, title string, message string, is_read boolean, created_at "
                     "timestamp_ntz",
    "warehouse_employees": "user_id bigint, warehouse_id int, role string, is_active boolean, created_at "
                           "timestamp_ntz, id bigint",
    "otp_cache": "identifier string, purpose string, expires_at bigint, is_used boolean",
    "app_settings": "key string, value string, updated_at timestamp_ntz",
    "commission_rates": "category string, rate decimal(5,2), gst_on_comm decimal(5,2), is_active boolean, id bigint, "
                        "updated_at timestamp_ntz",
}

# Constant defaults of the DDL (a clock default is NULL here).
DEFAULTS = {
    "users": {"first_name": "", "last_name": "", "role": "customer", "is_active": True},
    "otp_cache": {"purpose": "LOGIN", "is_used": False},
    "customers": {"total_orders": 0, "total_spent": 0, "loyalty_points": 0},
    "customer_addresses": {"country": "India", "address_type": "home", "is_default": False},
    "vendors": {"status": "pending", "is_verified": False, "vendor_type": "seller"},
    "vendor_documents": {"is_verified": False},
    "categories": {"sort_order": 0, "is_active": True, "is_featured": False},
    "brands": {"is_active": True},
    "products": {"stock_qty": 0, "unit": "Piece", "gst_rate": 5, "avg_rating": 0, "review_count": 0, "sold_count": 0, "is_active": True,
                 "is_featured": False},
    "inventory": {"current_stock": 0, "low_stock_threshold": 10},
    "product_images": {"sort_order": 0, "is_primary": False},
    "cart": {"quantity": 1},
    "orders": {"discount_amount": 0, "shipping_charge": 0, "payment_status": "pending", "order_status": "placed"},
    "payments": {"payment_status": "pending"},
    "coupons": {"minimum_order_amount": 0, "used_count": 0, "is_active": True},
    "reviews": {"is_approved": True},
    "notifications": {"is_read": False},
    "banners": {"sort_order": 0, "is_active": True},
    "user_permissions": {"granted": True},
    "manufacturers": {"is_active": True},
    "manufacturer_orders": {"total_amount": 0, "status": "pending"},
    "manufacturer_order_items": {"quantity": 1, "tax_rate": 0, "discount": 0},
    "cnf_companies": {"status": "active"},
    "warehouses": {"status": "active"},
    "warehouse_employees": {"role": "staff", "is_active": True},
    "warehouse_inventory": {"current_stock": 0, "reserved_stock": 0, "incoming_stock": 0, "outgoing_stock": 0},
    "cnf_orders": {"total_amount": 0, "payment_status": "pending", "order_status": "pending"},
    "cnf_order_items": {"quantity": 1},
    "salesmen": {"is_active": True},
    "commission_rates": {"rate": 8, "gst_on_comm": 18, "is_active": True},
}
_DIGITS = {T.ByteType(): 3, T.ShortType(): 5, T.IntegerType(): 10, T.LongType(): 19}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def widened(a: T.DataType, b: T.DataType, key: bool = False) -> T.DataType | None:
    """The type that holds all values of both; None where there is none (text beside numbers, but for keys)."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if a in _DIGITS and b in _DIGITS:
        return max(a, b, key=_DIGITS.get)
    exact = [(_DIGITS.get(x), 0) if x in _DIGITS else (x.precision - x.scale, x.scale) for x in (a, b)
             if x in _DIGITS or isinstance(x, T.DecimalType)]
    if len(exact) == 2:
        scale = max(s for _, s in exact)
        digits = max(n for n, _ in exact) + scale
        return T.DecimalType(digits, scale) if digits <= 38 else None
    kinds = {type(a), type(b)}
    if kinds <= {T.FloatType, T.DoubleType, *map(type, _DIGITS)}:
        return T.DoubleType()
    if kinds == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    return T.StringType() if key and T.StringType in kinds else None


def _named(df: DataFrame) -> dict[str, T.StructField]:
    return {f.name.lower(): f for f in df.schema.fields if f.name.lower() not in WITHHELD}


def common_schema(frames: list[DataFrame], table: str) -> T.StructType:
    """The declared columns, widened by what ``frames`` hold, then the unknown ones in order of appearance (names match in any case)."""
    declared = {f.name: f.dataType for f in schema(table).fields}
    out = dict(declared)
    for f in (f for df in frames for f in _named(df).items()):
        name, kind = f[0], f[1].dataType
        was = out.get(name, kind)
        out[name] = widened(was, kind, name == "id" or name.endswith("_id")) or (was if name in declared else T.StringType())
    return T.StructType([T.StructField(n, t) for n, t in out.items()])


def conform(df: DataFrame, table: str, target: T.StructType | None = None, misfits: str | None = None) -> DataFrame:
    """``df`` with the columns of ``target`` (default: the declared schema, widened, and the columns it doesn't name).

    A value that doesn't cast becomes NULL; ``misfits`` names a column that lists the names of such columns, row by row."""
    have, defaults = _named(df), DEFAULTS.get(table, {})
    cols, failed = [], []
    for f in (target or common_schema([df], table)).fields:
        if f.name in have:
            src = F.col(f"`{have[f.name].name}`")
            same = have[f.name].dataType == f.dataType
            value = src if same else src.try_cast(f.dataType)
            if not same:
                failed.append(F.when(src.isNotNull() & value.isNull(), F.lit(f.name)))
        else:
            value = F.lit(defaults.get(f.name)).cast(f.dataType)
        cols.append(value.alias(f.name))
    if misfits:
        none = F.array().cast("array<string>")
        cols.append((F.array_compact(F.array(*failed)) if failed else none).alias(misfits))
    return df.select(*cols)


def reconciled(frames: list[DataFrame], table: str, misfits: str | None = None) -> DataFrame:
    """All rows of ``frames`` (one per version of the files, at least one) under their common schema."""
    target = common_schema(frames, table)
    return reduce(DataFrame.unionByName, [conform(df, table, target, misfits) for df in frames])


def read_versions(spark: SparkSession, paths: list[str], table: str, misfits: str | None = None) -> DataFrame:
    """:func:`reconciled` Parquet folders, each written with one column set."""
    return reconciled([spark.read.parquet(p) for p in paths], table, misfits)


def misfit_report(df: DataFrame, misfits: str) -> DataFrame:
    """(column_name, n_rows): how many rows of a reconciled table hold a value that didn't cast."""
    return df.select(F.explode(misfits).alias("column_name")).groupBy("column_name").agg(F.count(F.lit(1)).alias("n_rows"))
