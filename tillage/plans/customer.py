"""Customer reports: customer 360 and address book."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.operators.aggregates import MONEY
from tillage.operators.sequences import running_position, wall_seconds
from tillage.plans.common import Registered
from tillage.sources.fixtures import Catalog, with_fixtures

VARIANTS = ("as_written", "corrected")


def customer_360(customers: DataFrame, users: DataFrame, orders: DataFrame, wishlist: DataFrame,
                 reviews: DataFrame, variant: str = "corrected", wishlist_key: str = "id") -> DataFrame:
    """Profile of every customer plus ``stats{total_orders, wishlist_count, review_count, total_spent}``.

    The reference left-joins orders, wishlist and reviews together, so every
    paid order is summed once per (wishlist row x review row) of the customer.
    ``as_written`` reproduces that value as ``paid_sum * greatest(w, 1) *
    greatest(r, 1)`` from per-customer counts -- the cross product is never
    built; ``corrected`` sums each paid order once. ``wishlist_key`` names the
    wishlist row identity (``id`` in the full schema).
    """
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")
    o = orders.groupBy(F.col("customer_id").alias("__c")).agg(
        F.count_distinct("id").alias("total_orders"),
        F.sum(F.when(F.col("payment_status") == "paid", F.col("final_amount")).otherwise(F.lit(0))).alias("__paid"))
    w = wishlist.groupBy(F.col("customer_id").alias("__c")).agg(
        F.count_distinct(wishlist_key).alias("wishlist_count"), F.count(F.lit(1)).alias("__wrows"))
    r = reviews.groupBy(F.col("customer_id").alias("__c")).agg(
        F.count_distinct("id").alias("review_count"), F.count(F.lit(1)).alias("__rrows"))
    profile = [c for c in ("email", "mobile", "gender", "occupation", "farm_size", "primary_crop", "dob")
               if c in users.columns]
    u = users.select(F.col("id").alias("__uid"), "first_name", "last_name", *profile)
    # Names come from the user row (the reference selects u.first_name, u.last_name).
    c = customers.drop(*[n for n in ("first_name", "last_name", *profile) if n in customers.columns])
    prof = c.join(u, c.user_id == u.__uid).drop("__uid")
    j = (prof.join(o, prof.id == o.__c, "left").drop("__c")
         .join(w, F.col("id") == w.__c, "left").drop("__c")
         .join(r, F.col("id") == r.__c, "left").drop("__c"))
    paid = F.coalesce(F.col("__paid"), F.lit(0))
    if variant == "as_written":
        fan = F.greatest(F.coalesce(F.col("__wrows"), F.lit(0)), F.lit(1)) * \
            F.greatest(F.coalesce(F.col("__rrows"), F.lit(0)), F.lit(1))
        paid = paid * fan
    stats = F.struct(F.coalesce(F.col("total_orders"), F.lit(0)).cast("bigint").alias("total_orders"),
                     F.coalesce(F.col("wishlist_count"), F.lit(0)).cast("bigint").alias("wishlist_count"),
                     F.coalesce(F.col("review_count"), F.lit(0)).cast("bigint").alias("review_count"),
                     paid.cast(MONEY).alias("total_spent"))
    base = [c for c in prof.columns]
    return j.select(*base, F.trim(F.concat_ws(" ", "first_name", "last_name")).alias("full_name"),
                    stats.alias("stats"))


def address_book(addresses: DataFrame, segment_rows: int = 1024) -> DataFrame:
    """Every customer's addresses, default first then newest, with their ``position``.

    Positions come from :func:`running_position`, so even a customer with a
    huge address list is numbered by many tasks: segments are (default flag,
    time bucket or id range), which never decrease along the sort order.
    """
    order = [F.col("is_default").desc()]
    if "created_at" in addresses.columns:
        order.append(F.col("created_at").desc())
        bucket = -F.floor(wall_seconds(F.col("created_at")) / F.lit(86_400))
    else:
        bucket = -F.floor(F.col("id") / F.lit(segment_rows))
    order.append(F.col("id").desc())
    # NULLs sort last under desc(), so they get the last segment too.
    flag = F.when(F.col("is_default"), 0).when(~F.col("is_default"), 1).otherwise(2)
    segment = F.struct(flag.alias("d"), F.coalesce(bucket.cast("bigint"), F.lit(2 ** 62)).alias("b"))
    return running_position(addresses, ["customer_id"], order, segment)


def _r33(variant: str):
    def build(c: Catalog) -> DataFrame:
        df = customer_360(c.customers, c.users, c.orders, c.wishlist, c.reviews, variant, wishlist_key="product_id")
        return df.select("id", "customer_code", "occupation", "first_name", "last_name", "full_name",
                         "stats.total_orders", "stats.wishlist_count", "stats.review_count", "stats.total_spent")
    return build


def _r33_sql(variant: str) -> str:
    spent = ("sum(CASE WHEN o.payment_status='paid' THEN o.final_amount ELSE 0 END)" if variant == "as_written"
             else "(SELECT coalesce(sum(final_amount), 0) FROM fx_orders x WHERE x.customer_id=c.id AND x.payment_status='paid')")
    return with_fixtures(f"""SELECT c.id, c.customer_code, c.occupation, u.first_name, u.last_name,
  trim(concat_ws(' ', u.first_name, u.last_name)) AS full_name,
  count(DISTINCT o.id) AS total_orders, count(DISTINCT w.product_id) AS wishlist_count,
  count(DISTINCT r.id) AS review_count, CAST(coalesce({spent}, 0) AS DECIMAL(38,2)) AS total_spent
FROM fx_customers c JOIN fx_users u ON c.user_id=u.id
LEFT JOIN fx_orders o ON o.customer_id=c.id LEFT JOIN fx_wishlist w ON w.customer_id=c.id
LEFT JOIN fx_reviews r ON r.customer_id=c.id
GROUP BY c.id, c.customer_code, c.occupation, u.first_name, u.last_name""",
                         "fx_customers", "fx_users", "fx_orders", "fx_wishlist", "fx_reviews")


REGISTRY = [
    Registered("r33_customer_360_as_written", _r33("as_written"), _r33_sql("as_written")),
    Registered("r33_customer_360_corrected", _r33("corrected"), _r33_sql("corrected")),
    Registered(
        "r34_address_book",
        lambda c: address_book(c.addresses),
        with_fixtures("""SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY is_default DESC, id DESC)
  AS position FROM fx_addresses""", "fx_addresses")),
]
