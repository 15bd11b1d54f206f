"""Literal row sources (seed ``VALUES``) and S3: typed settings with defaults.

These tables are fixed-size by construction (a handful of rows each), so the
joins that use them may broadcast them without any further size check.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillage.functions.exprs import php_float

# The two settings that change results (delivery rule), with their defaults.
DELIVERY_FREE_THRESHOLD_DEFAULT = 499.0
DELIVERY_CHARGE_DEFAULT = 49.0

# And one JSON value, for decoding.
SETTINGS_ROWS = [
    ("delivery_free_threshold", "499"),
    ("delivery_charge", "49"),
    ("opening_days", '[{"day":"Monday","hours":8},{"day":"Tuesday","hours":6}]'),
]

SETTINGS_SCHEMA = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), False),
])

# Coupon seed (code, type, value, minimum order). The seed's
# NOW() is pinned to COUPON_SEEDED_AT; validity is 30 and 60 days from it.
COUPON_SEEDED_AT = dt.datetime(2001, 7, 15, 0, 0, 0)
COUPONS = [
    ("AGRO10", "percentage", "10.00", "299.00", 30),
    ("FIRST50", "flat", "50.00", "199.00", 60),
]

COUPON_SCHEMA = T.StructType([
    T.StructField("code", T.StringType(), False),
    T.StructField("discount_type", T.StringType(), False),
    T.StructField("discount_value", T.DecimalType(10, 2), False),
    T.StructField("minimum_order_amount", T.DecimalType(10, 2), True),
    T.StructField("max_discount", T.DecimalType(10, 2), True),
    T.StructField("is_active", T.BooleanType(), True),
    T.StructField("valid_from", T.TimestampNTZType(), False),
    T.StructField("valid_to", T.TimestampNTZType(), False),
])


def seed_settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SETTINGS_ROWS, SETTINGS_SCHEMA)


def seed_coupons(spark: SparkSession) -> DataFrame:
    rows = [(code, kind, Decimal(v), Decimal(m), None, True, COUPON_SEEDED_AT,
             COUPON_SEEDED_AT + dt.timedelta(days=days))
            for code, kind, v, m, days in COUPONS]
    return spark.createDataFrame(rows, COUPON_SCHEMA)


def _setting(settings: DataFrame, key: str, default: float) -> Column:
    """One key's value as PHP ``(float)($settings[key] ?? default)``: the default
    only when the key is absent; a present value is read leniently ('12abc' -> 12)."""
    raw = F.max(F.when(F.col("key") == key, F.col("value")))
    return F.when(raw.isNull(), F.lit(default)).otherwise(php_float(raw))


def delivery_settings(settings: DataFrame) -> DataFrame:
    """S3: the two delivery settings as one typed row (defaults 499 / 49)."""
    return (settings.where(F.col("key").isin("delivery_free_threshold", "delivery_charge"))
            .agg(_setting(settings, "delivery_free_threshold", DELIVERY_FREE_THRESHOLD_DEFAULT)
                 .alias("free_threshold"),
                 _setting(settings, "delivery_charge", DELIVERY_CHARGE_DEFAULT)
                 .alias("delivery_charge")))
