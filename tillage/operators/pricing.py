"""M8 order pricing and M12 invoice totals, in decimal arithmetic.

M8 rules: free delivery when the subtotal *before* discount reaches the
threshold; a coupon applies only when the subtotal reaches its minimum; a
percentage discount is capped by ``max_discount`` when set; a flat discount
is not capped at the subtotal; ``usage_limit`` is not checked; the coupon
counts as used even below the minimum; any line over stock rejects the order.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillage.functions.exprs import money_round, ntz
from tillage.operators.aggregates import MONEY
from tillage.operators.joins import join_valid, scalar
from tillage.functions.exprs import php_trim
from tillage.sources.literals import delivery_settings


def price_orders(requests: DataFrame, cart: DataFrame, products: DataFrame, coupons: DataFrame,
                 settings: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Price a checkout request per customer (``customer_id``, optional ``coupon_code``)."""
    rule = scalar(delivery_settings(settings).select(F.struct(
        F.col("free_threshold").cast(MONEY).alias("t"), F.col("delivery_charge").cast(MONEY).alias("c"))))
    threshold, charge = rule["t"], rule["c"]
    pr = products.where(F.col("is_active")).select(F.col("id").alias("product_id"), "selling_price", "stock_qty")
    lines = cart.join(requests.select("customer_id"), "customer_id", "left_semi").join(pr, "product_id")
    per = lines.groupBy("customer_id").agg(
        F.sum(F.col("selling_price") * F.col("quantity")).cast(MONEY).alias("subtotal"),
        F.count(F.lit(1)).alias("line_count"),
        F.bool_and(F.col("quantity") <= F.col("stock_qty")).alias("__stock_ok"))
    req = requests.withColumn("__code", F.upper(php_trim("coupon_code")))
    live = coupons.where(F.coalesce(F.col("is_active"), F.lit(True))).select(
        F.col("code").alias("__cp"), "discount_type", "discount_value", "minimum_order_amount", "max_discount",
        "valid_from", "valid_to")
    # Equi join on the code with the validity range as a residual; adaptive
    # execution broadcasts the coupons if they measure small.
    j = join_valid(req.join(per, "customer_id", "left"), live, "__code", "__cp", ntz(as_of),
                   "valid_from", "valid_to")
    sub = F.col("subtotal")
    pct = sub * F.col("discount_value") / F.lit(100)
    pct = F.when(F.col("max_discount").isNotNull(), F.least(pct, F.col("max_discount"))).otherwise(pct)
    discount = (F.when(F.col("discount_type").isNull() | (sub < F.coalesce(F.col("minimum_order_amount"), F.lit(0))),
                       F.lit(0))
                .when(F.col("discount_type") == "percentage", pct)
                .otherwise(F.col("discount_value")))
    delivery = F.when(sub >= threshold, F.lit(0)).otherwise(charge)
    status = (F.when(F.col("line_count").isNull(), "rejected_empty_cart")
              .when(~F.col("__stock_ok"), "rejected_stock").otherwise("placed"))
    placed = status == "placed"
    return j.select(
        "customer_id", F.col("coupon_code"),
        status.alias("status"),
        F.when(placed, sub).alias("subtotal"),
        F.when(placed, money_round(discount)).alias("discount"),
        F.when(placed, delivery.cast(MONEY)).alias("delivery"),
        F.when(placed, money_round(sub - discount + delivery)).alias("total"),
        (placed & F.col("discount_type").isNotNull()).alias("coupon_used"))


def invoice_totals(lines: DataFrame, order_key: str = "order_id") -> DataFrame:
    """Per order: line count and ``sum(coalesce(qty, 1) * coalesce(unit_price, 0))``
    (tax_rate and discount are stored but not applied, as in the reference)."""
    amount = F.coalesce(F.col("quantity"), F.lit(1)) * F.coalesce(F.col("unit_price"), F.lit(0))
    return lines.groupBy(order_key).agg(F.count(F.lit(1)).alias("line_count"),
                                        F.sum(amount).cast(MONEY).alias("total_amount"))
